"""The published search cases: names in any order, accents, initials, swaps, plurals and rejections."""

import pytest

from prismlake.operators import search as S

ROWS = [(0, "Machine Consciousness", "Helliwell, Alice"), (1, "Alice and the philosophy of science", "Morgan, Beth"), (2, "Embodiment and agency", "García Márquez, José"), (3, "Consciousness in machines", "Alice H. Helliwell")]


@pytest.fixture(scope="module")
def prepared(spark):
    p = S.prepare(spark.createDataFrame(ROWS, "k long, t string, a string"), "k", "t", "a").cache()
    return p, S.index(p).cache()


def test_form(spark):
    from pyspark.sql import functions as F

    from prismlake.functions.text import search_form

    text = "  García-Márquez, José "
    assert S.query_form(text) == "garcia marquez jose"
    assert spark.range(1).select(search_form(F.lit(text))).first()[0] == "garcia marquez jose"


@pytest.mark.parametrize("query, want", [
    ("Alice Helliwell", [0, 3]), ("Jose Garcia Marquez", [2]), ("a", []), ("A H Helliwell", [3]), ("Helliwlel Alice", [0, 3]), ("Hellawoll", []),
])
def test_cases(prepared, query, want):
    assert [r["row"] for r in S.search(*prepared, query, 4).collect()] == want


@pytest.mark.parametrize("query", ["machine consciousness", "machines consciousness"])
def test_first_two(prepared, query):
    assert [r["row"] for r in S.search(*prepared, query, 4).collect()][:2] == [0, 3]


@pytest.mark.parametrize("query", ["D Chalmers", "David Chalmers"])
@pytest.mark.parametrize("author", ["Chalmers, David J.", "Chalmers, David"])
def test_author_before_title(spark, query, author):
    rows = spark.createDataFrame([(0, "A response to David Chalmers", "Bishop, John"), (1, "The Conscious Mind", author)], "k long, t string, a string")
    p = S.prepare(rows, "k", "t", "a")
    assert [r["row"] for r in S.search(p, S.index(p), query, 2).collect()] == [1, 0]


def test_empty(spark):
    p = S.prepare(spark.createDataFrame([], "k long, t string, a string"), "k", "t", "a")
    assert S.search(p, S.index(p), "anything").collect() == []


def test_near_words_and_shared_words(spark):
    from prismlake.operators import linkage as L

    words = ["cognitive", "kognitive", "defesa", "difesa", "ocgnitive", "cognitve", "theory", "of"]
    w = spark.createDataFrame([(x,) for x in words], "a string")
    got = {(r["a"], r["b"]) for r in L.near_words(w, w.withColumnRenamed("a", "b")).where("a < b").collect()}
    assert got == {("cognitive", "kognitive"), ("cognitive", "ocgnitive"), ("cognitive", "cognitve"), ("defesa", "difesa")}
    left = spark.createDataFrame([(1, "emotivsm"), (2, "of"), (2, "moral")], "r int, a string")
    right = spark.createDataFrame([("x", "emotivism"), ("y", "moral"), ("z", "or")], "w string, b string")
    assert {tuple(r) for r in L.sharing_words(left, right, "r", "w").collect()} == {(1, "x"), (2, "y")}


def test_promising_has_the_best_of_all_pairs(spark, monkeypatch):
    """The pairs that bounds leave over give the same best candidates as all pairs; blocks are small here."""
    import random

    from pyspark.sql import functions as F

    from prismlake.functions.text import link_form
    from prismlake.operators import linkage as L
    from prismlake.plans import searching

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    title = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))

    def typed(t: str) -> str:
        k = rng.randrange(len(t))
        return t[:k] + rng.choice("aeinü ") + t[k + rng.randint(0, 1) :]

    works = [(j, title(), rng.choice(["Doe, J.", "Ann Ruß; Roe, K.", None]), rng.choice([None, 1999, 2004])) for j in range(120)]
    works += [(200, works[0][1], *works[0][2:]), (201, None, "Doe, J.", 1999), (202, "?!", None, None), (None, works[5][1], None, None)]
    records = [(i, typed(rng.choice(works[:120])[1]) if i % 2 else title(), rng.choice(["Doe, J.", "Russ, Ann", None]), rng.choice([None, 2000, 2003])) for i in range(60)]
    records += [(90, works[0][1], *records[0][2:]), (91, "", None, 2000), (92, None, None, None), (93, "qqqqq", "Doe, J.", 2000), (1, title(), "Roe, K.", 2003), (None, works[0][1], None, None)]
    p = spark.createDataFrame(records, "record_id long, title string, creator string, source_year int")
    w = spark.createDataFrame(works, "work_id long, candidate_title string, candidate_authors string, candidate_year int")
    monkeypatch.setattr(L, "RECORD_BLOCK", 20)
    monkeypatch.setattr(L, "WORK_BLOCK", 30)
    monkeypatch.setattr(searching, "table", lambda s, sf, name: {"enrichment_pilot": p, "candidate_works": w}[name])
    words = lambda d, key, title, name: d.select(key, F.explode(F.array_distinct(F.split(link_form(F.col(title)), " "))).alias(name)).where(F.col(name) != "")
    ids = L.sharing_words(words(p, "record_id", "title", "a"), words(w, "work_id", "candidate_title", "b"), "record_id", "work_id")
    every = L.best_candidate(ids.join(p, "record_id").join(w, "work_id"), "record_id", "title", "creator", "source_year", "candidate_title", "candidate_authors", "candidate_year", "work_id")
    expected = {tuple(r) for r in every.select("record_id", "work_id", "score").collect()}
    seen = []
    real = L.best_candidate
    monkeypatch.setattr(L, "best_candidate", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    assert {tuple(r) for r in searching.linkage_scores(spark, "").collect()} == expected
    assert len(expected) > 55 and seen[0] < ids.count() / 4  # few pairs get the exact ratio


def test_common_subsequence():
    import random

    import numpy as np

    from prismlake.operators import linkage as L

    rng = random.Random(1)
    texts = sorted(("".join(rng.choice("abc de1") for _ in range(rng.randint(0, 150))) for _ in range(40)), key=len)
    place = {c: i for i, c in enumerate(L._LETTERS)}
    codes = np.full((150, 40), len(L._LETTERS), np.uint8)
    for i, t in enumerate(texts):
        codes[: len(t), i] = [place[c] for c in t]
    sizes = np.array([len(t) for t in texts])

    def slow(a: str, b: str) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for a in (texts[0], texts[7], texts[20], texts[39], "a" * 64, "ab" * 32 + "c"):
        got = L.common_subsequence(np.array([place[c] for c in a], dtype=np.int64), codes, sizes)
        assert got.tolist() == [slow(a, b) for b in texts]
