"""Sample, term counts, token counts, packing and mixing."""

import random

import pytest
from conftest_llm import write
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlake.llm import p4_sample as S
from prismlake.llm import p5_terms as C
from prismlake.llm import p7_pack as B
from prismlake.llm import p8_mix as X
from prismlake.llm import tokens as T

ROWS = [(f"P{i}", "1999" if i % 3 else "n.d.", 1 + i % 4) for i in range(3000)]
SCHEMA = "paper_id string, pub_date string, snapshot_no int"


def drawn(df, rates=None, default=S.DEFAULT_RATE):
    found = S.deliveries(df, "paper_id", S.period(F.col("pub_date")), "snapshot_no")
    limits = S.raised(None, S.rates_table(df.sparkSession, S.RATES if rates is None else rates))
    return {r["key"]: r["drawn_snapshot"] for r in S.draw(found, limits, default).collect()}


def test_sample_stays(frame):
    whole = frame(ROWS + ROWS[:200] + [(None, "2000", 1), ("", "2000", 1)], SCHEMA)
    final = drawn(whole.repartition(7))
    assert final == drawn(whole.repartition(2)) and 0 < len(final) < len(ROWS) and "" not in final
    before: dict = {}
    for k in (1, 2, 3, 4):
        now = drawn(whole.where(F.col("snapshot_no") <= k))
        assert before.keys() <= now.keys() and all(now[p] == s for p, s in before.items())
        before = now
    assert before == final


def test_sample_redelivery(frame):
    assert drawn(frame(ROWS + [(p, d, s + 3) for p, d, s in ROWS[:900]], SCHEMA)) == drawn(frame(ROWS, SCHEMA))


def test_sample_late_delivery(frame):
    """Late rows of an old snapshot, in the same stratum or another, drop nobody and don't lift anybody else."""
    before = drawn(frame(ROWS, SCHEMA))
    late = [(f"P{i}", "1985" if i % 2 else "2015", 1) for i in range(0, 3000, 7)] + [(f"late{i}", "1999", 1) for i in range(3000)]
    after = drawn(frame(ROWS + late, SCHEMA))
    assert before.keys() <= after.keys()
    touched = {p for p, _, _ in late}
    assert after.keys() - before.keys() <= touched


def test_sample_rates_hold_at_any_size(frame):
    for n in (200, 3000, 30000):
        got = drawn(frame([(f"K{i}", "1999", 1) for i in range(n)], SCHEMA), {"1980-1999": 0.2})
        assert abs(len(got) / n - 0.2) < 4 * (0.2 * 0.8 / n) ** 0.5
    assert len(drawn(frame(ROWS, SCHEMA), {}, 1.0)) == len(ROWS) and drawn(frame(ROWS, SCHEMA), {"undated": 0.0, "1980-1999": None or 0.0}) == {}


def test_thresholds_are_kept_and_only_rise(spark, tmp_path):
    path = f"file://{tmp_path}/thresholds"
    S.Thresholds(spark, path).raise_to(S.rates_table(spark, {"a": 0.1, "b": 0.5}))
    S.Thresholds(spark, path).raise_to(S.rates_table(spark, {"a": 0.3, "b": 0.2, "c": 0.7}))
    store = S.Thresholds(spark, path)
    assert store.version() == 2 and {tuple(r) for r in store.read().collect()} == {("a", 0.3), ("b", 0.5), ("c", 0.7)}


def test_sample_empty(frame):
    assert drawn(frame([], SCHEMA)) == {}
    assert set(drawn(frame([("A", None, None)], SCHEMA), {"undated": 1.0}).items()) == {("A", 0)}


VERSIONS = [
    [(1, "a b b"), (2, "b c"), (3, None), (5, "")],
    [(2, "c c d"), (1, "a b b"), (4, "É é x2y"), (6, "b " * 3000)],  # 2 changed, 1 came again, 4 and 6 are new
    [(3, "late"), (4, None), (99, None)],  # 4 is deleted, 99 never was there
    [],
]


def test_terms(spark, frame, tmp_path):
    """Each version through a new store over the same folder gives the counts of a recount."""
    path, schema = f"file://{tmp_path}/counts", "key long, text string"
    plain = lambda d: sorted(map(tuple, d.select("term", "uses", "records").collect()))
    state: dict = {}
    for k, rows in enumerate(VERSIONS, 1):
        former = frame(list(state.items()), schema)
        got = C.CountStore(spark, path, 4).apply(frame(rows, schema), former if k > 1 else None)
        state |= dict(rows)
        state = {a: b for a, b in state.items() if b is not None}
        want = C.term_deltas(C.signed_changes(None, frame(list(state.items()), schema)))
        assert plain(got) == plain(want)
        store = C.CountStore(spark, path, 999)
        assert (store.version, store.buckets) == (k, 4) and plain(store.counts()) == plain(want)
        assert sorted(r["key"] for r in store.digests().collect()) == sorted(state)
    store.vacuum()
    assert plain(C.CountStore(spark, path).counts()) == plain(want)
    with pytest.raises(ValueError):
        store.apply(frame([(1, "other")], schema))
    marks = {r["term"]: r["mark"] for r in C.mark(store.counts(), 3, 2, 0.5).collect()}
    assert marks["a"] == "rare" and marks["b"] == "common"


def test_untouched_buckets_stay(spark, frame, tmp_path):
    store = C.CountStore(spark, f"file://{tmp_path}/counts", 16)
    store.apply(frame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)], "key long, text string"))
    store.apply(frame([(1000, "wordaa")], "key long, text string"))
    assert [v for (k, _), v in store.places.items() if k == "terms"].count(2) == 1
    assert [v for (k, _), v in store.places.items() if k == "digests"].count(2) == 1


def test_terms_from_tables(spark, tmp_path):
    write(spark, tmp_path, "search_rows", [(1, "A b", 1, 0), (1, "A b", 2, 0), (None, "zz", 1, 0)], "paper_idx long, title string, snapshot_no int, abstract int")
    write(spark, tmp_path, "detail_rows", [(1, "b-c", 5), (1, "b-c", 6), (7, "gone", 7)], "paper_idx long, abstract string, title int")
    assert sorted(map(tuple, C.p5_counts(spark, str(tmp_path)).collect())) == [("a", 1, 1, "rare"), ("b", 2, 1, "rare"), ("c", 1, 1, "rare")]


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("tiktoken")
    return T.load(T.VOCABULARY).encode_ordinary, T.counter(T.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é'1.\n\t   s!")), max_size=40))
def test_token_counts(encoder, text):
    encode, count = encoder
    assert count(text) == len(encode(text))


def test_tokens_of_rows(frame):
    got = T.with_tokens(frame([(1, None, "x"), (2, "", "y"), (3, "two words", "z")], "doc_id long, text string, n string"))
    assert [(r["doc_id"], r["n"], r["n_tokens"]) for r in got.orderBy("doc_id").collect()] == [(1, "x", 0), (2, "y", 0), (3, "z", 2)]


CAPS = [("small", 10), ("large", 64), (None, None), ("none", 0)]


def test_packing(frame):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice([0, 1, 3, 9, 10, 11, 25, 64, 65, 200])) for i in range(400)]
    out = B.containers(frame(sizes, "doc_id long, n_tokens long"), frame(CAPS, "size_name string, capacity_tokens int"), "doc_id", shard_items=50).toPandas()
    for name, cap in (("small", 10), ("large", 64)):
        p = out[out["size_name"] == name]
        assert p.groupby("container")["n_tokens"].sum().max() <= cap
        for i, n in sizes:
            parts = p[p["key"] == i].sort_values("part")
            assert parts["n_tokens"].sum() == n and (len(parts) <= 1 or n > cap)
            assert list(parts["first_token"]) == [k * cap for k in range(len(parts))]
        assert p["n_tokens"].sum() / (p["container"].nunique() * cap) > 0.85
    assert B.containers(frame([], "doc_id long, n_tokens long"), frame(CAPS, "size_name string, capacity_tokens int"), "doc_id").collect() == []


def test_cost_balance():
    k = B.pack([8, 8, 4, 4, 4, 4], 16)
    loads = [sum(n for n, j in zip([8, 8, 4, 4, 4, 4], k) if j == i) for i in set(k)]
    assert sorted(loads) == [16, 16]
    assert len(B.pack([], 16)) == 0


def test_mix_brute_force(frame):
    rnd = random.Random(4)
    docs = [(i, rnd.choice("aaabbc"), rnd.randint(0, 30)) for i in range(600)] + [(900, None, 5), (901, "z", 5)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 1), ("zero", 0.0, 3)]
    d, t = frame(docs, "doc_id long, source string, n_tokens long"), frame(targets, "source string, target_share double, max_repeats int")
    uses = X.finish_times(d, t, "doc_id", cell_rows=20)
    rows = uses.collect()
    share = {s: (w, m) for s, w, m in targets}
    for s in "abc":
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["finish"])
        total = 0
        for r in own:
            total += r["n_tokens"]
            assert r["finish"] == pytest.approx(total / share[s][0])
        assert len(own) == share[s][1] * sum(1 for x in docs if x[1] == s and x[2] > 0)
    for budget in (0, 1, 500, 4000, 10**9):
        want, total = set(), 0
        for r in sorted(rows, key=lambda r: (r["finish"], r["source"], r["key"], r["use_no"])):
            if total + r["n_tokens"] > budget:
                break
            total += r["n_tokens"]
            want.add((r["source"], r["key"], r["use_no"]))
        got = {(r["source"], r["key"], r["use_no"]) for r in X.truncate(uses, budget, bins=16).collect()}
        assert got == want
    assert X.truncate(X.finish_times(d.limit(0), t, "doc_id"), 100).collect() == []
