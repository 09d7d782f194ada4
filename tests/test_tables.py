"""Ordered readers, shards, linkage by families, stability of clusters, centroids of term weights, composite scores."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.functions import numeric as N
from prismlake.operators import linkage as L
from prismlake.operators import partition as P
from prismlake.operators import textstats as S
from prismlake.sources import readers as R
from prismlake.sources import sinks as K


def test_shards_in_order(spark, tmp_path):
    parts = [[["a", 1], ["b", 2]], [], [["c", 3]], [["d", None], ["e", 5], ["f", 6]]]
    for i, rows in enumerate(parts):
        (tmp_path / f"part-{i:02d}.json").write_text(json.dumps(rows))
        (tmp_path / f"lines-{i:02d}.txt").write_text("\n".join(f" {r[0]} \n" for r in rows))
    got = R.json_positional(spark, str(tmp_path / "part-*.json"), ["name", "n"], 6).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], r["n"]) for r in got] == [(i, n, v) for i, (n, v) in enumerate(zip("abcdef", ["1", "2", "3", None, "5", "6"]))]
    assert [tuple(r) for r in R.text_lines(spark, str(tmp_path / "lines-*.txt")).orderBy("ordinal").collect()] == list(enumerate("abcdef"))
    with pytest.raises(ValueError):
        R.json_positional(spark, str(tmp_path / "part-*.json"), ["name"], 7)


def test_shard_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SHARDS_A_FOLDER", 3)
    rows = spark.range(100).withColumnRenamed("id", "paper_idx")
    K.shards(rows, str(tmp_path / "s"), size=7)
    assert len(list((tmp_path / "s").glob("folder=*"))) == 5
    for chunk in (0, 5, 14, 99):
        assert sorted(r["paper_idx"] for r in K.shard(spark, str(tmp_path / "s"), chunk).collect()) == [i for i in range(100) if i // 7 == chunk]


def test_neighbour_shards(spark, tmp_path):
    lists = [(i, [i + 1, i + 2]) for i in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "paper_idx long, n array<long>")
    K.neighbour_shards(frame(lists), str(tmp_path / "n"), 2, size=3)
    got = {r["chunk"]: (r["first"], bytes(r["packed"])) for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    assert {k: f for k, (f, _) in got.items()} == {0: 0, 1: 3}
    assert [int.from_bytes(got[1][1][i : i + 3], "little") for i in range(0, 12, 3)] == [4, 5, 5, 6]
    for bad in (lists[:-1] + [(4, [1])], lists + [(4, [1, 2])], lists[1:]):
        with pytest.raises(ValueError):
            K.neighbour_shards(frame(bad), str(tmp_path / "m"), 2)


def test_families_on_both_sides(spark):
    rows = [(1, "Minds", "Müller, Jane", 2000, "Minds", "Jane Müller", 2000, 1), (2, "Minds", "Jane Doe", 2000, "Minds", "Roe, Jane; Doe, J.", 2000, 1), (3, "Minds", "Doe, Jane", 2000, "Minds", "Jane Roe", 2000, 1), (4, "Minds", None, 2000, "Minds", None, 2000, 1), (5, "Minds", "", None, "Minds", ";", None, 1)]
    pairs = spark.createDataFrame(rows, "r long, t string, c string, y int, o string, p string, oy int, w long")
    got = {x["r"]: x["author_match"] for x in L.best_candidate(pairs, "r", "t", "c", "y", "o", "p", "oy", "w").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_a_hit_that_repeats_the_source(spark):
    rows = spark.createDataFrame([("OpenAlex", "The Example Index", True), ("Crossref", "The Example Index", True), ("OpenAlex", None, True)], "provider string, journal string, a boolean")
    ok = L.accepted(F.lit(1.0), F.col("a"), F.lit(1), F.lit(2000), F.lit(2000), F.lit(True), L.circular(F.col("journal"), F.col("provider"), "example index"))
    assert [r[0] for r in rows.coalesce(1).select(ok).collect()] == [False, True, True]


def test_cluster_stability(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-1, 3, 60)
    runs = {r: np.where(rng.random(60) < 0.3, rng.integers(-1, 3, 60), a) for r in range(5)}
    rows = [(r, int(x), int(y)) for r, b in runs.items() for x, y in zip(a, b)]
    counts = spark.createDataFrame(rows, "run int, a int, b int").groupBy("run", "a", "b").agg(F.count("*").alias("observed"))
    for got in P.cluster_stability(counts).collect():
        js = [max((((a == got["a"]) & (b == y)).sum() / ((a == got["a"]) | (b == y)).sum() for y in range(3)), default=0) for b in runs.values()]
        assert (got["runs"], got["size"]) == (5, (a == got["a"]).sum())
        assert [got[c] for c in ("jaccard_mean", "jaccard_median", "jaccard_min", "low", "high")] == pytest.approx([np.mean(js), np.median(js), min(js), *np.percentile(js, [2.5, 97.5])])


def test_nearest_class(spark):
    rng = np.random.default_rng(4)
    w = rng.random((12, 6)) * (rng.random((12, 6)) < 0.6)
    lab = rng.integers(0, 3, 12)
    long = spark.createDataFrame([(int(d), f"t{t}", float(w[d, t])) for d, t in zip(*np.nonzero(w))], "doc long, term string, w double")
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lab)], "doc long, label int")
    c = np.array([w[lab == k].sum(axis=0) for k in range(3)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    score = w @ c.T
    got = {r["doc"]: r for r in S.nearest_class(long, labels, S.term_centroids(long, labels)).collect()}
    assert [got[i]["nearest"] for i in range(12)] == score.argmax(axis=1).tolist()
    assert [got[i]["own"] for i in range(12)] == pytest.approx([score[i, lab[i]] for i in range(12)], abs=1e-8)
    assert [got[i]["other"] for i in range(12)] == pytest.approx([np.delete(score[i], lab[i]).max() for i in range(12)], abs=1e-8)


def test_weights(spark):
    assert all(sum(w.values()) == pytest.approx(1) for w in N.WEIGHTS.values())
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 1.0), (2.0, 3.0)], "coherence double, perplexity double").coalesce(1)
    got = [r[0] for r in rows.select(N.composite({"coherence": 0.5, "perplexity": 0.5}, Window.partitionBy())).collect()]
    assert sorted(got) == pytest.approx([0.0, 0.5, 1.0])
