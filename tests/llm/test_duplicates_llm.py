"""Near-duplicate groups against brute force, components, and the match cascade."""

import random

import pytest
from conftest_llm import write

from prismlake.llm import p2_neardup as D
from prismlake.llm import p3_match as M
from prismlake.llm.components import components


def texts(n=120):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(900)]
    rows = [[rnd.choice(vocab) for _ in range(80)] for _ in range(n)]
    for i in range(40):  # edited copies, from very close to just too far
        t = list(rows[i])
        for _ in range(i % 12):
            t[rnd.randrange(80)] = rnd.choice(vocab)
        rows.append(t)
    rows += [list(rows[3])] * 5 + [list(rows[4][::-1])]
    return rows


def test_like_brute_force(spark, tmp_path):
    rows = texts()
    write(spark, tmp_path, "search_rows", [(i, f"Title word{i % 7}", "c") for i in range(len(rows))] + [(None, "no id", "c"), (9999, None, "c")], "paper_idx long, title string, abstract string")
    write(spark, tmp_path, "detail_rows", [(i, " ".join(t).upper(), "t") for i, t in enumerate(rows)] + [(0, " ".join(rows[0]).upper(), "t"), (500, None, "t"), (501, "", "t"), (502, "too short", "t")], "paper_idx long, abstract string, title string")
    sets = [set(t) | {"title", f"word{i % 7}"} for i, t in enumerate(rows)]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= D.THRESHOLD}
    got = D.p2_found(spark, str(tmp_path)).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want and len(want) > 40
    groups = {r["paper_idx"]: r["group_idx"] for r in D.p2_groups(spark, str(tmp_path)).collect()}
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)


def test_hot_block_in_cells(frame):
    """All records share a block: cells of any size lose no pair."""
    prints = frame([(i, [7, i + 100], 0, 0) for i in range(30)], "id long, keys array<long>, s0 long, s1 long")
    assert {tuple(r) for r in D.block_pairs(prints, cell=4).collect()} == {(i, j) for i in range(30) for j in range(i + 1, 30)}


def test_empty(frame):
    members, links = D.near_duplicates(frame([], "id long, w array<int>"))
    assert members.collect() == [] and links.collect() == []


def test_components(frame):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    got = {r["id"]: r["component"] for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for k, v in want.items() if k != v} <= set(got)
    assert components(frame([], "a long, b long")).collect() == []


RECORDS = [(1, "The Uses of Logic: An Essay", "Krasada, Jane M.", 2001), (2, "On Doubt, Again", "Belou, Emil", None), (3, "Against Luck", "Torvik, Rick", 1990), (4, None, "Nobody, N.", 2000), (5, "", None, 2000), (6, "Against Luck", "Torvik, Richard", 1990), (7, "Moral Testimony and Moral Luck", "Quimba, Zoë", 2010), (8, "Games We Play", "Voss, Lars", 1999)]
WORKS = [
    (11, "THE USES OF LOGIC – AN ESSAY", "J. Krasada; Maria Other", 2003, "Crossref"), (12, "The uses of logic", "Jane M. Krasada", 2001, "OpenAlex"), (13, "The Uses of Logic: An Essay", "Jane M. Krasada", 2007, "Crossref"),
    (14, "On Doubt, Again", None, 2001, "Crossref"), (15, "On Doubt, Again*", "Emil Belou", 1950, "OpenAlex"), (16, "Erratum: Against Luck", "Richard Torvik", 1990, "Crossref"), (17, "Against Luck", "Richard Torvik", 1991, "OpenAlex"),
    (18, "Against Luck", "Somebody Else", 1990, "Crossref"), (19, "Moral Testimny and Moral Luck", "Zoë Quimba", 2010, "Crossref"), (19, "Moral Testimny and Moral Luck", "Zoë Quimba", 2010, "Crossref"),
    (20, "Moral Testimony and Moral Luck (II)", "Zoë Quimba", 2010, "OpenAlex"), (21, "Games We Play", "", 1999, "Crossref"), (22, None, "Lars Voss", 1999, "OpenAlex"),
]


def test_cascade(frame):
    r = frame(RECORDS, "record_id long, title string, creator string, year int")
    w = frame(WORKS, "work_id long, title string, people string, year int, provider string").dropDuplicates(["work_id"])
    got = {(x["record_id"], x["work_id"]) for x in M.cascade(r, w).collect()}
    assert got == {(1, 11), (1, 12), (2, 15), (3, 17), (6, 17), (7, 19), (8, 21)}


def test_cascade_empty(frame):
    r, w = frame([], "record_id long, title string, creator string, year int"), frame(WORKS, "work_id long, title string, people string, year int, provider string")
    assert M.cascade(r, w).collect() == [] == M.cascade(frame(RECORDS, "record_id long, title string, creator string, year int"), w.limit(0)).collect()


@pytest.mark.parametrize("a, b, want", [("moral luck again", "moral luck again", 3), ("moral luck again", "moral lukc again", 2), ("the moral luck again", "moral luck again", 1), ("moral luck again", "moral luck again ii", 0), ("moral luck again", "erratum moral luck again", 0), ("moral luck i", "moral luck ii", 0)])
def test_titles(a, b, want):
    assert M.title_relation(a.split(), b.split()) == want


def test_confidence_is_smoothed(spark, sf):
    rows = M.p3_matches(spark, sf).select("rule", "confidence").distinct().collect()
    assert rows and all(0 < r["confidence"] < 1 for r in rows)


@pytest.mark.parametrize("a, b", [("moral luck again", "moral lukc again"), ("the moral luck again", "moral luck again"), ("on moral luck and its many uses", "on moral luck and many uses"), ("vari ous uses of logic", "various uses of logic"), ("a b c d e f g h i", "a b c d e f x h i")])
def test_titles_one_word_apart_share_a_piece(a, b):
    assert M.pieces(a.split()) & M.pieces(b.split())


def test_main_titles():
    main = lambda a, b: M.main_relation(*(M.title_words(t)[0] for t in (a, b)), *(M.title_words(t)[1] for t in (a, b)))
    assert main("On Moral Luck: Three Questions and a Reply", "On moral luck") and main("Luck – A Short Story: An Essay", "Luck: A short story")
    assert not main("On Moral Luck", "On Moral Luck: Part II") and not main("On Moral Luck: A", "On Moral Luck: A (II)") and not main("Luck: An Essay", "Luck")


def test_hot_key_is_split(frame):
    """A key that all rows share loses no pair and adds none, nor does a key beside it."""
    from prismlake.llm.hot import hot_buckets, split_join

    left = frame([(7, i) for i in range(60)] + [(8, 100)], "key long, a long")
    right = frame([(7, i) for i in range(90)] + [(8, 1), (9, 2)], "key long, b long")
    hot, none = hot_buckets([(left, right), (left.where("key = 8"), right)], 10)
    assert hot.count() == 1 and none.count() == 1  # one side is enough
    for h in (hot, hot_buckets([(left, right)])[0]):
        got = [tuple(r) for r in split_join(left, right, "a", "b", h).collect()]
        assert len(got) == len(set(got)) == 60 * 90 + 1 and (100, 1) in got


def test_one_work_for_many_records_of_a_hot_title(frame):
    own = [f"{a}{b}{c}sada" for a in "bdfgk" for b in ("ra", "lou", "ni", "me") for c in ("vor", "tik", "zan")]
    r = frame([(i, "Editorial", f"{x}, Jane", 2000) for i, x in enumerate(own)], "record_id long, title string, creator string, year int")
    w = frame([(i, "Editorial", f"Jane {x}", 2000, "Crossref") for i, x in enumerate(own)], "work_id long, title string, people string, year int, provider string")
    got = M.cascade(r, w).collect()
    assert {(x["record_id"], x["work_id"]) for x in got} == {(i, i) for i in range(len(own))}
