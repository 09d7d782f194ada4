"""Language parts and subject areas."""

import numpy as np
import pandas as pd
import pytest

from prismlake.llm import p6_language as L
from prismlake.llm import p9_subjects as A


@pytest.mark.parametrize("label, code", [("en", "en"), ("EN_us", "en"), ("German", "de"), ("pt-BR", "pt"), ("dut", "nl"), (None, None), ("", None), ("??", None), ("n/a", None), ("Klingon", "other"), ("français", "fr")])
def test_labels(label, code):
    assert L.label_code(label) == code


def brute(word, p, number):
    """Sum over all segmentations of the marked word."""
    s = "▁" + word

    def total(i):
        if i == len(s):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(s) + 1):
            k = number.get(s[i:j])
            if k is None and j == i + 1:
                k = len(number)
            if k is not None:
                out += p[k] * total(j)
        return out

    return total(0)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    p = np.array([0.1, 0.2, 0.1, 0.05, 0.15, 0.3, 0.05, 1e-6, 0.0])[:, None]
    words = L.Words(pieces)
    for w in ("a", "abab", "babx", "b", "aabba"):
        assert np.exp(words.scores([w], p)[0, 0]) == pytest.approx(brute(w, p[:, 0], words.number))


def test_parts():
    e, d = np.array([5.0, -5.0]), np.array([-5.0, 5.0])
    assert L.parts_of(np.stack([e, e, d, d, d]), 8) == [(0, 2, 0), (2, 5, 1)]
    assert L.parts_of(np.stack([e, e, d, e, e]), 8) == [(0, 5, 0)]  # one sentence makes no part
    assert L.parts_of(np.stack([e, d]), 8) == [(0, 2, 0)]
    assert L.parts_of(np.zeros((1, 2)), 8) == [(0, 1, 0)]


def all_parts(scores, switch):
    """The best value over all ways to cut into parts of two sentences or more."""
    n = len(scores)
    value = [switch] + [-np.inf] * n
    for j in range(2, n + 1):
        value[j] = max(value[i] + scores[i:j].sum(axis=0).max() - switch for i in range(j - 1))
    return value[n]


@pytest.mark.parametrize("seed", range(30))
def test_parts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(4, 40)), int(rng.integers(2, 6))
    scores = rng.normal(size=(n, k)) * 3 + 6 * np.eye(k)[np.sort(rng.integers(0, k, n))]
    parts = L.parts_of(scores, 8.0)
    assert [a for a, _, _ in parts] == [0] + [b for _, b, _ in parts[:-1]] and parts[-1][1] == n and all(b - a >= 2 for a, b, _ in parts)
    if len(parts) > 1:
        got = sum(scores[a:b, l].sum() for a, b, l in parts) - 8.0 * (len(parts) - 1)
        assert got == pytest.approx(all_parts(scores, 8.0))
    else:
        assert scores.sum(axis=0).max() >= all_parts(scores, 8.0) - 1e-9 or (scores.argmax(axis=1) == scores.argmax(axis=1)[0]).all()


def test_parts_of_a_book():
    """The work grows with the sentences, not with their square."""
    scores = np.zeros((40_000, 7))
    scores[:25_000, 0] = scores[25_000:, 3] = 5.0
    assert L.parts_of(scores, 8.0) == [(0, 25_000, 0), (25_000, 40_000, 3)]


def test_sentences():
    assert L.split_sentences("One is. (Two) “is”. Es ist. 3 is") == ["One is.", "(Two) “is”.", "Es ist. 3 is"]
    assert L.split_sentences("   ") == []


def test_segments(spark, sf):
    pieces, p = L.language_model(spark, sf)
    en = "The argument is that the view of the world was not what they had in mind. This is one of the reasons for which we have to go on."
    de = "Das ist nicht die Antwort auf die Frage, die wir stellen. Es gibt keine andere Lesart, die mit den Gründen der Autoren vereinbar ist."
    rows = [
        (1, "P1", "The view of the world", en, "en"), (2, "P2", "P2", en + " " + de, "en"), (3, "P3", "Die Antwort auf die Frage", en, "en-GB"), (4, "P4", None, de, "fr"), (5, "P5", "x", "123 456", None), (6, "P6", "Kurz", de * 40, "de"),
    ]
    got = {}
    for r in L.segments(spark.createDataFrame(rows, "key long, paper_id string, title string, abstract string, label string"), (pieces, p)).collect():
        got.setdefault(r["key"], []).append((r["seg_no"], r["lang_code"], r["listed"]))
    assert sorted(got[1]) == [(0, "en", False), (1, "en", False)]
    assert sorted(got[2]) == [(1, "en", True), (2, "de", True)]
    assert sorted(got[3]) == [(0, "de", True), (1, "en", True)]
    assert sorted(got[4]) == [(1, "de", True)] and sorted(got[5]) == [(1, "en", True)] and sorted(got[6]) == [(1, "de", False)]


def test_held_out_labels(spark, sf):
    """Labels that name a language agree with the model for nearly all abstracts."""
    model = L.language_model(spark, sf)
    s = L.segments(L._papers(spark, sf), model).where("seg_no = 1").select("key", "lang_code")
    both = L._papers(spark, sf).select("key", "label").join(s, "key").toPandas()
    both["named"] = both["label"].map(L.label_code)
    both = both[both["named"].isin(L.LANGUAGES)]
    assert (both["named"] == both["lang_code"]).mean() > 0.85


def test_cleaning():
    clean = A.cleaner()
    text = "Title<br>\n\nBody of the text about rights, which goes on for long enough to be a line of text in its own right, as they do, and ends with a bro-\nken word.\n17\n[Page 3 of the scan is blank.]\n\nReferences\nDoe, J. (1999). On Frogs.\nRoe, R. (2001). On Toads."
    out = clean(text)
    assert "broken" in out and "Frogs" not in out and "17" not in out and "scan" not in out and "<" not in out
    assert clean("") == "" and clean("one line") == "one line"


def subject_rows(n=400):
    rng = np.random.default_rng(0)
    words = {"law": ["court", "statute", "judge", "verdict", "appeal"], "bio": ["cell", "gene", "species", "protein", "enzyme"], "art": ["painting", "canvas", "sculptor", "gallery", "portrait"]}
    docs, labels = [], []
    for i in range(n):
        own = sorted(rng.choice(list(words), size=1 + (i % 4 == 0), replace=False))
        lines = []
        for k in range(8):
            area = own[k % len(own)]
            lines.append("We consider " + " and ".join(rng.choice(words[area], 2, replace=False)) + " in this section of the paper.")
        docs.append((i, "en", " ".join(lines), "law"))
        if i % 5 == 0:
            labels += [(i, a) for a in own]
    return docs, labels


def test_subjects(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAVES", 12)
    monkeypatch.setattr(A, "MAX_SHARE", 0.6)
    monkeypatch.setattr(A, "TREE_DOCS", 150)
    docs, labels = subject_rows()
    extra = [(1000, "en", None, "x"), (1001, "en", "  ", "x"), (1002, None, "Nothing of the kind here.", "x")]
    areas = pd.DataFrame({"area_code": ["law", "bio", "art", None], "area_name": ["Law", "Life", "Arts", "?"], "scope_note": ["court", None, "painting", "?"]})
    out = A.subjects(spark.createDataFrame(docs + extra, "doc_id long, lang string, text string, area_code string"), spark.createDataFrame(labels + [(0, "nope"), (7777, "law")], "doc_id long, area_code string"), areas).where("share >= 0.25").collect()
    got: dict = {}
    for r in out:
        got.setdefault(r["doc_id"], set()).add(r["area_code"])
    want = {d[0]: {a for a, w in (("law", "court statute judge verdict appeal"), ("bio", "cell gene species protein enzyme"), ("art", "painting canvas sculptor gallery portrait")) if any(x in d[2] for x in w.split())} for d in docs}
    assert np.mean([got.get(i) == w for i, w in want.items()]) > 0.95 and not {1000, 1001, 1002} & set(got)


def test_subjects_take_all_documents_and_labels(spark, monkeypatch):
    """The bounds that once cut the tree's documents and the labels change nothing."""
    monkeypatch.setattr(A, "LEAVES", 6)
    monkeypatch.setattr(A, "MAX_SHARE", 0.6)
    docs, labels = subject_rows(200)
    areas = pd.DataFrame({"area_code": ["law", "bio", "art"], "area_name": ["?", "?", "?"], "scope_note": [None, None, None]})
    d = spark.createDataFrame([x[:3] for x in docs], "doc_id long, lang string, text string").coalesce(1)
    l = spark.createDataFrame(labels, "doc_id long, area_code string")
    seen, real = [], A.word_areas
    monkeypatch.setattr(A, "word_areas", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {tuple(r) for r in A.subjects(d, l, areas).collect()}
    monkeypatch.setattr(A, "TREE_DOCS", 20)
    monkeypatch.setattr(A, "LABELLED", 3)
    assert {tuple(r) for r in A.subjects(d, l, areas).collect()} == got and len(got) > 190
    assert all(np.allclose(x, y) for x, y in zip(*seen))


def test_subjects_empty(spark):
    d, l = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, area_code string")
    assert A.subjects(d, l, pd.DataFrame({"area_code": ["law"], "area_name": ["Law"], "scope_note": [None]})).collect() == []
