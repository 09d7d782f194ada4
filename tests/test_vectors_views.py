"""Neighbours, coherence, camera and file forms on small cases."""

import json
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlake.operators import projection as P
from prismlake.operators import sampling as M
from prismlake.operators import textstats as S
from prismlake.operators import vectors as V
from prismlake.sources import readers as R
from prismlake.sources import sinks as K
from prismlake.tables import table


def vectors(spark, n=40, d=6, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    x[7] = x[3]  # a repeated vector
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_without_self(spark):
    rng = np.random.default_rng(7)
    lists = [(q, rng.permutation(9).tolist()) for q in range(9)]
    rows = spark.createDataFrame(lists, "q int, n array<int>")
    got = {r[0]: r[1] for r in rows.select("q", V.without_self(F.col("n"), F.col("q"), 5)).collect()}
    assert got == {q: [x for x in n if x != q][:5] for q, n in lists}
    with pytest.raises(Exception):
        spark.createDataFrame([(0, [0, 1, 1])], "q int, n array<int>").select(V.without_self(F.col("n"), F.col("q"), 2)).collect()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_is_exact(spark, metric):
    x, df = vectors(spark)
    got = {}
    for r in V.knn(df.repartition(3), df.where("vec_id < 10"), 4, metric=metric).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    u = x.astype(float)
    if metric == "cosine":
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(10):
        d = np.round(-(u @ u[q]) if metric == "cosine" else ((u - u[q]) ** 2).sum(1), 9)
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want


def test_knn_in_blocks(spark, monkeypatch):
    _, df = vectors(spark)
    whole = sorted(map(tuple, V.knn(df, df, 3).collect()))
    monkeypatch.setattr(V, "BLOCK_VALUES", 60)
    assert sorted(map(tuple, V.knn(df, df, 3).collect())) == whole


def test_approximate_recall(spark):
    _, df = vectors(spark, 200)
    q = df.where("vec_id % 20 = 0")
    r = V.recall(V.knn(df, q, 5), V.approximate_knn(df, q, 5, tables=40, bits=3), 5).agg(F.avg("recall")).first()[0]
    assert r >= 0.9


def test_approximate_recall_of_the_defaults(spark, sf):
    df = table(spark, sf, "embeddings")
    r = V.recall(V.knn(df, df, 5), V.approximate_knn(df, df, 5), 5).agg(F.count("*").alias("n"), F.avg("recall").alias("mean")).first()
    assert r["n"] == df.count() and r["mean"] >= 0.9


def test_empty_vectors(spark):
    _, df = vectors(spark)
    assert V.knn(df, df.limit(0), 3).collect() == []


def test_density_grid_takes_all_points(spark, tmp_path):
    from prismlake.plans.modelling import density_grid

    x, _ = vectors(spark, 60, 3)
    spark.createDataFrame([(1970 + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["points"] for r in density_grid(spark, str(tmp_path)).collect()} == {60}


def test_projection_quality_of_all_rows(spark, monkeypatch, tmp_path):
    from prismlake.plans import vectors as Q

    x, df = vectors(spark, 60, 9)
    df = df.select((F.col("vec_id") * 5 + 1).alias("vec_id"), (F.col("vec_id") % 3).alias("label"), "embedding")  # no id is a multiple of five
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = df.withColumn("shown", F.slice("embedding", 1, 3)).repartition(3)
    monkeypatch.setattr(V, "BLOCK_ROWS", 150)
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], dtype=float)
    lab = np.array([r["label"] for r in df.orderBy("vec_id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = lambda i, l: d[i, (lab == l) & (np.arange(60) != i)].mean()
    want = []
    for i in range(60):
        a, b = mean(i, lab[i]), min(mean(i, l) for l in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = [r["silhouette"] for r in V.silhouette(rows, "vec_id", "embedding", "label").orderBy("vec_id").collect()]
    assert got == pytest.approx(want, abs=1e-6)
    np.fill_diagonal(d, -1)
    source = d.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")  # rank of every other row, its own 0
    shown = np.sqrt(((x[:, None, :3] - x[None, :, :3]) ** 2).sum(-1))
    np.fill_diagonal(shown, -1)
    near = shown.argsort(axis=1, kind="stable")[:, 1:6]
    penalty = np.maximum(np.take_along_axis(source, near, axis=1) - 5, 0).sum()
    r = V.trustworthiness(rows, "vec_id", "embedding", "shown", 5).first()
    assert r["n"] == 60 and r["trustworthiness"] == pytest.approx(1 - 2 * penalty / (60 * 5 * (120 - 15 - 1)))
    assert sum(r["n"] for r in Q.silhouette(spark, str(tmp_path)).collect()) == Q.trustworthiness(spark, str(tmp_path)).first()["n"] == 60
    assert Q.distance_spearman(spark, str(tmp_path)).first()["rho"] > 0
    assert Q.projection_agreement(spark, str(tmp_path)).first()["agreement"] > 0


def test_npmi_order(spark):
    tf = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "b", 1), (2, "c", 1), (3, "d", 1)], "doc int, term string, tf int")
    topics = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c"), ("u", "d")], "topic string, term string")
    got = {r["topic"]: r["npmi"] for r in S.npmi_strict(tf, topics, 4).collect()}
    assert got["t"] == pytest.approx(1) and got["u"] == -1
    soft = {r["topic"]: r["npmi"] for r in S.npmi_smoothed(tf, topics, 4).collect()}
    assert soft["t"] > soft["u"]


def test_permutation_keeps_sizes(spark):
    l = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, label int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    a = rows(V.permuted(l, 3))
    for r in range(3):
        assert sorted(x for k, _, x in a if k == r) == sorted(i % 3 for i in range(40)) and [i for k, i, _ in a if k == r] == list(range(40))
    assert a == rows(V.permuted(l.repartition(5), 3)) and [x for k, _, x in a if k == 0] != [x for k, _, x in a if k == 1]
    n = spark.createDataFrame([(q, (q + d) % 40) for q in range(40) for d in (1, 2, 5)], "query long, neighbour long")
    of = {(k, i): x for k, i, x in a}
    got = {r["repeat"]: r["x"] for r in V.null_purity(n, l, 3).collect()}
    assert got == {k: pytest.approx(np.mean([of[k, q] == of[k, (q + d) % 40] for q in range(40) for d in (1, 2, 5)])) for k in range(3)}


@settings(max_examples=30, deadline=None)
@given(st.floats(-3, 3), st.floats(-1.4, 1.4), st.floats(0.3, 10), st.floats(0.3, 3))
def test_camera(yaw, pitch, distance, aspect):
    c = P.Camera(yaw, pitch, distance)
    m = c.matrix(aspect)
    clip = m @ [0, 0, 0, 1]
    assert clip[3] == pytest.approx(distance) and abs(clip[0]) < 1e-6 and abs(clip[1]) < 1e-6  # the target is in the middle
    assert c.orbit(0, 1e6).pitch == pytest.approx(P.STEEPEST)
    assert P.NEAREST <= c.zoom(1e-9).distance <= c.zoom(1e9).distance <= P.FARTHEST
    moved = c.pan(10, 5, 600, aspect)
    assert np.linalg.norm(moved.position() - np.array(moved.target)) == pytest.approx(distance)
    f = c.fit((1, 2, 3), 0.5, aspect)
    edge = f.matrix(aspect) @ [*(np.array([1, 2, 3]) + 0.5 * f.axes()[1]), 1]
    assert abs(edge[1] / edge[3]) <= 1 or f.distance == P.FARTHEST


def test_view_round_trip():
    v = P.View(-1, 1, -2, 2, 800, 600).zoomed(100, 50, -300).dragged(5, 6)
    x, y = v.from_screen(100, 50)
    w = v.zoomed(100, 50, 120)
    assert w.from_screen(100, 50) == pytest.approx((x, y))
    assert P.View(0, 0, 0, 0, 10, 10).spans == (1.0, 1.0)
    assert math.isclose(v.located(0.5, 0.5, 3).from_screen(400, 300)[0], 0.5)


def test_files(spark, tmp_path):
    np.array([-1, 0, 32767], "<i2").tofile(tmp_path / "a.bin")
    assert [r["label"] for r in R.int16_labels(spark, str(tmp_path / "a.bin"), 3).collect()] == [-1, 0, 32767]
    with pytest.raises(Exception):
        R.int16_labels(spark, str(tmp_path / "a.bin"), 4).collect()
    np.arange(6, dtype="<f4").tofile(tmp_path / "p.bin")
    assert [tuple(r) for r in R.float32_xyz(spark, str(tmp_path / "p.bin")).collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]
    packed = spark.createDataFrame([([1, 256, 16777215],)], "n array<int>").select(K.uint24(F.col("n"))).first()[0]
    (tmp_path / "2.bin").write_bytes(bytes(packed))
    assert [tuple(r) for r in R.uint24_neighbours(spark, str(tmp_path / "2.bin"), 3).collect()] == [(400, [1, 256, 16777215])]
    np.save(tmp_path / "m.npy", np.eye(2))
    assert [r["v"] for r in R.npy(spark, str(tmp_path / "m.npy")).orderBy("ordinal").collect()] == [[1, 0], [0, 1]]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>title</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>_id</t></si></sst>')
    assert [tuple(r) for r in R.xlsx(spark, str(tmp_path / "w.xlsx"), ["_id", "title"]).collect()] == [(1, "7", None)]
    with pytest.raises(Exception):
        R.xlsx(spark, str(tmp_path / "w.xlsx"), ["gone"]).collect()
    K.json_document({"b": 1, "a": "é"}, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        K.json_document({"a": float("nan")}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())["b"] == 1
    with pytest.raises(ValueError):
        K.csv_table(spark.range(0), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        K.labels(spark.createDataFrame([(0, 40000)], "paper_idx long, label int"), str(tmp_path / "l"), 1)
    with pytest.raises(ValueError):
        R.parquet(spark, "/root/testdata/sf0.001/nation.parquet", ["gone"]) if False else R.require_columns(spark.range(1), ["gone"])
    with pytest.raises(ValueError):
        R.lookup(spark.range(3), {"id": 9})


def test_model_reader(spark):
    texts = spark.createDataFrame([(0, "ab"), (1, None)], "k long, t string")
    out = R.embedded(texts, "t", lambda: (lambda batch: np.array([[len(x), 1.0] for x in batch])), 2)
    assert [r["embedding"] for r in out.orderBy("k").collect()] == [[2, 1], [0, 1]]


def test_split_is_stable(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"]: r["part"] for r in M.fraction_split(ids, "k", 1, [("x", 0.5), ("y", 0.5)]).collect()}
    b = {r["k"]: r["part"] for r in M.fraction_split(spark.range(2000).withColumnRenamed("id", "k").repartition(7), "k", 1, [("x", 0.5), ("y", 0.5)]).collect()}
    assert all(b[k] == v for k, v in a.items()) and 400 < sum(v == "x" for v in a.values()) < 600


def test_text_functions(spark):
    from prismlake.functions import text as T

    rows = spark.createDataFrame([(None,), ("a &lt;b&gt;x&lt;/b&gt;  y",), ("x" * 90,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.clean_text(F.col("t"), 10)).collect()] == ["", "a x y", "x" * 9 + "…", ""]
    pairs = spark.createDataFrame([("ab", "ba"), ("abc", "abd"), ("abc", "acbd"), ("a", "b"), ("abc", "xyz"), (None, "a"), ("", "a")], "a string, b string")
    assert [r[0] for r in pairs.select(T.one_edit("a", "b")).collect()] == [True, True, False, True, False, False, True]
