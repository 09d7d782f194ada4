"""Vectors: normalisation, exact and approximate neighbours, centroids, purity, permutation null, projection quality.

Exact search compares a stated set of queries with all rows: the queries are broadcast in blocks of bounded size and
each partition of the corpus keeps its best k per query, so what is shuffled is queries x partitions x k rows. The
approximate search hashes rows by random projections (several tables) and verifies candidates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sampling import random_pairs

#: Values of one broadcast block of queries: at most 64 MB of doubles.
BLOCK_VALUES = 8_000_000
#: Rows of one block where all rows are compared with all.
BLOCK_ROWS = 8_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def normalised(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def slices(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Parts of the batches whose distances from so many rows are at most BLOCK_VALUES values."""
    step = max(1, BLOCK_VALUES // max(1, rows))
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step]


def knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", v: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(query, neighbour, rank, score): the k nearest others, ties by key. Score: cosine, or squared distance.

    The query set is read in blocks bounded by BLOCK_VALUES; self is removed by key, not by place.
    """
    spark = corpus.sparkSession
    rows = queries.select(key, v)
    width = len((rows.first() or [0, [0]])[1])
    size = max(1, BLOCK_VALUES // max(1, width))
    blocks = -(-2 * rows.count() // size)  # twice as many as needed, as a hash spreads unevenly
    numbered = rows.select(F.pmod(F.xxhash64(key), F.lit(max(1, blocks))).alias("block"), F.col(key).alias("id"), F.col(v).alias("v"))
    out = None
    for b in range(blocks if rows.head(1) else 0):
        part = numbered.where(F.col("block") == b).select("id", "v").toPandas()
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), np.array(part["v"].to_list(), dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            if metric == "cosine":
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            top_s, top_i = np.empty((len(qid), 0)), np.empty((len(qid), 0), np.int64)
            for pdf in slices(batches, len(qid)):
                x = np.array(pdf[v].to_list(), dtype=np.float64)
                ids = pdf[key].to_numpy(np.int64)
                if metric == "cosine":
                    s = -np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T, 9)
                else:
                    s = np.round(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0), 9)
                s[qid[:, None] == ids[None]] = np.inf
                top_s, top_i = np.concatenate([top_s, s], 1), np.concatenate([top_i, np.broadcast_to(ids, s.shape)], 1)
                if top_s.shape[1] > k:
                    order = np.lexsort((top_i, top_s), axis=1)[:, :k]
                    top_s, top_i = np.take_along_axis(top_s, order, 1), np.take_along_axis(top_i, order, 1)
            ok = np.isfinite(top_s)
            r, c = np.nonzero(ok)
            yield pd.DataFrame({"query": qid[r], "neighbour": top_i[r, c], "s": top_s[r, c]})

        found = corpus.select(key, v).mapInPandas(best, "query long, neighbour long, s double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query long, neighbour long, rank int, score double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("s", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("query", "neighbour", "rank", (-F.col("s") if metric == "cosine" else F.col("s")).alias("score"))


def approximate_knn(corpus: DataFrame, queries: DataFrame, k: int, tables: int = 96, bits: int = 6, key: str = "vec_id", v: str = "embedding", seed: int = 5) -> DataFrame:
    """(query, neighbour, rank, score) by random-hyperplane tables; every row is indexed, candidates are verified exactly.

    A neighbour at angle t is found with probability 1 - (1 - (1 - t/pi)^bits)^tables. The defaults are for vectors whose
    nearest neighbours are far off (60 degrees: 0.9998, 75 degrees: 0.979); the closer they are, the fewer tables do.
    """
    rng = np.random.default_rng(seed)
    width = len((corpus.select(v).first() or [[0]])[0])
    planes = rng.standard_normal((tables * bits, width))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].to_list(), dtype=np.float64)
            b = ((x @ planes.T) > 0).reshape(len(x), tables, bits)
            code = (b * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "codes": list(code)})

    def hashed(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(v).alias("v")).mapInPandas(keys, "id long, v array<float>, codes array<long>")

    c, q = hashed(corpus), hashed(queries)
    pairs = q.select(F.col("id").alias("query"), F.explode("codes").alias("code")).join(c.select(F.col("id").alias("neighbour"), F.explode("codes").alias("code")), "code").where("query <> neighbour").select("query", "neighbour").distinct()
    scored = pairs.join(q.select(F.col("id").alias("query"), normalised(F.col("v")).alias("qv")), "query").join(c.select(F.col("id").alias("neighbour"), normalised(F.col("v")).alias("cv")), "neighbour")
    scored = scored.select("query", "neighbour", F.round(dot(F.col("qv"), F.col("cv")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))).where(F.col("rank") <= k)


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, recall): share of the exact neighbours that were found."""
    hit = exact.select("query", "neighbour").join(found.select("query", "neighbour").withColumn("hit", F.lit(1)), ["query", "neighbour"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def without_self(neighbours: Column, own: Column, k: int) -> Column:
    """The first k different neighbours other than the row itself; raises if there are fewer."""
    kept = F.slice(F.array_distinct(F.filter(neighbours, lambda x: x != own)), 1, k)
    return F.when(F.size(kept) < k, F.raise_error(F.lit("a row has too few neighbours"))).otherwise(kept)


def centroids(rows: DataFrame, label: str, v: str = "embedding") -> DataFrame:
    """(label, c): normalised sum of the members' normalised vectors, summed by place before any shuffle."""
    each = rows.select(F.col(label).alias("label"), F.posexplode(normalised(F.col(v))).alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    s = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("s"))
    return s.select("label", normalised(F.col("s")).alias("c"))


def centroid_scores(rows: DataFrame, cents: DataFrame, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(key, label, score) for each row and centroid; centroids are as many as labels and are broadcast."""
    named = cents.select(F.col("label").alias("centroid"), "c")
    return rows.crossJoin(F.broadcast(named)).select(*[x for x in rows.columns if x != v], "centroid", F.round(dot(normalised(F.col(v)), F.col("c")), 9).alias("score"))


def nearest_centroid(rows: DataFrame, cents: DataFrame, own: str, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(key, own label, nearest, own_score, other_score, margin)."""
    scores = centroid_scores(rows.select(key, F.col(own).alias("own"), v), cents, key, v)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "centroid"))
    return (
        scores.withColumn("place", best).groupBy(key, "own")
        .agg(F.max(F.when(F.col("place") == 1, F.col("centroid"))).alias("nearest"), F.max(F.when(F.col("centroid") == F.col("own"), F.col("score"))).alias("own_score"), F.max(F.when(F.col("centroid") != F.col("own"), F.col("score"))).alias("other_score"))
        .withColumn("margin", F.col("own_score") - F.col("other_score"))
    )


def representatives(rows: DataFrame, cents: DataFrame, own: str, top: int = 10, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(label, place, key, score): members most similar to their centroid; a join on the label, not with every centroid."""
    s = rows.where(F.col(own) >= 0).select(key, F.col(own).alias("label"), v).join(F.broadcast(cents), "label").select("label", key, F.round(dot(normalised(F.col(v)), F.col("c")), 9).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), key))).where(F.col("place") <= top)


def purity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, purity): share of a row's neighbours with its label; rows of noise ask nothing. labels: (id, label)."""
    own = labels.select(F.col("id").alias("query"), "label").where("label >= 0")
    n = neighbours.join(own, "query").join(labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return n.groupBy("query", "label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("purity"))


def permuted(labels: DataFrame, repeats: int, seed: str = "null") -> DataFrame:
    """(repeat, id, label): labels in random orders that keep every label's size: the i-th row by hash gets the i-th
    label. Each repeat is ordered by itself, so there are as many tasks as repeats. labels: (id, label)."""
    each = labels.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    place = lambda *by: F.row_number().over(Window.partitionBy("repeat").orderBy(*by)).alias("i")
    by_hash = each.select("repeat", "id", place(F.xxhash64(F.lit(seed), "repeat", "id"), "id"))
    return by_hash.join(each.select("repeat", "label", place("label", "id")), ["repeat", "i"]).select("repeat", "id", "label")


def null_purity(neighbours: DataFrame, labels: DataFrame, repeats: int, seed: str = "null") -> DataFrame:
    """(repeat, x): mean purity of the same neighbours under each permutation of the labels."""
    p = permuted(labels, repeats, seed)
    own = p.where("label >= 0").select("repeat", F.col("id").alias("query"), "label")
    n = neighbours.select("query", "neighbour").join(own, "query").join(p.select("repeat", F.col("id").alias("neighbour"), F.col("label").alias("other")), ["repeat", "neighbour"])
    per = n.groupBy("repeat", "query").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("purity"))
    return per.groupBy("repeat").agg(F.avg("purity").alias("x"))


def blocks(rows: DataFrame, key: str, widths: int) -> Iterator[pd.DataFrame]:
    """All rows, in blocks for the driver of about BLOCK_ROWS rows and BLOCK_VALUES values; widths: values of a row."""
    n = -(-rows.count() // min(BLOCK_ROWS, max(1, BLOCK_VALUES // widths)))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == b).toPandas()
        if len(part):
            yield part


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a from all rows of b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def silhouette(rows: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """(key, label, silhouette) with Euclidean distances, of all rows: each block is compared with all rows in batches. A row
    alone in its label has 0."""
    spark, out = rows.sparkSession, None
    rows = rows.select(F.col(key).cast("long").alias("x"), F.col(label).cast("long").alias("lx"), F.col(v).alias("v"))
    for part in blocks(rows, "x", len((rows.first() or [0, 0, [0]])[2])):
        shared = spark.sparkContext.broadcast((part["x"].to_numpy(np.int64), part["lx"].to_numpy(np.int64), np.array(part["v"].to_list(), dtype=np.float64)))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, lx, q = shared.value
            total: dict[int, list] = {}
            for pdf in slices(batches, len(x)):
                other = x[:, None] != pdf["x"].to_numpy(np.int64)[None]
                d = np.sqrt(distances(q, np.array(pdf["v"].to_list(), dtype=np.float64))) * other
                ly = pdf["lx"].to_numpy(np.int64)
                for l in np.unique(ly):
                    t = total.setdefault(int(l), [np.zeros(len(x)), np.zeros(len(x), np.int64)])
                    t[0] += d[:, ly == l].sum(1)
                    t[1] += other[:, ly == l].sum(1)
            for l, (d, n) in total.items():
                yield pd.DataFrame({"x": x, "lx": lx, "ly": l, "s": d, "n": n})

        found = rows.mapInPandas(sums, "x long, lx long, ly long, s double, n long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"{key} long, label long, silhouette double")
    d = out.groupBy("x", "lx", "ly").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    s = d.groupBy("x", "lx").agg(F.max(F.when(F.col("lx") == F.col("ly"), F.col("d"))).alias("a"), F.min(F.when(F.col("lx") != F.col("ly"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.select(F.col("x").alias(key), F.col("lx").alias("label"), value.alias("silhouette"))


def trustworthiness(rows: DataFrame, key: str, source: str, shown: str, k: int) -> DataFrame:
    """(trustworthiness, n) of a projection, of all rows: neighbours shown that are far away in the source cost their rank.
    The k neighbours shown of every row, then, block by block, how many rows are nearer in the source than each."""
    spark, out = rows.sparkSession, None
    near = knn(rows, rows, k, key, shown, "euclidean").select("query", "neighbour")
    each = rows.select(F.col(key).cast("long").alias("x"), F.col(source).alias("v"))
    pairs = near.join(each.toDF("query", "a"), "query").join(each.toDF("neighbour", "b"), "neighbour")
    pairs = cut(pairs.select("query", "neighbour", "a", F.round(squared_distance(F.col("a"), F.col("b")), 9).alias("ds")))
    for part in blocks(pairs, "query", len((each.first() or [0, [0]])[1])):
        shared = spark.sparkContext.broadcast((part["query"].to_numpy(np.int64), part["neighbour"].to_numpy(np.int64), np.array(part["a"].to_list(), dtype=np.float64), part["ds"].to_numpy(np.float64)))

        def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, q, ds = shared.value
            n = np.zeros(len(x), np.int64)
            for pdf in slices(batches, len(x)):
                ids = pdf["x"].to_numpy(np.int64)[None]
                d = np.round(distances(q, np.array(pdf["v"].to_list(), dtype=np.float64)), 9)
                n += (((d < ds[:, None]) | (d == ds[:, None]) & (ids < y[:, None])) & (ids != x[:, None]) & (ids != y[:, None])).sum(1)
            yield pd.DataFrame({"query": x, "neighbour": y, "n": n})

        found = each.mapInPandas(nearer, "query long, neighbour long, n long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "trustworthiness double, n long")
    rank = out.groupBy("query", "neighbour").agg((F.sum("n") + 1).alias("rs"))
    n = rows.count()
    return rank.agg((1.0 - 2.0 * F.sum(F.greatest(F.col("rs") - k, F.lit(0))) / F.lit(float(n) * k * (2.0 * n - 3.0 * k - 1.0))).alias("trustworthiness"), F.lit(n).cast("long").alias("n"))


def pair_distances(rows: DataFrame, key: str, source: str, shown: str, pairs: int, seed) -> DataFrame:
    """(d, e): squared distances in the source and as shown of random pairs over all rows (equal ends left out)."""
    numbered = rows.select((F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("number"), F.col(key))
    end = numbered.join(rows.select(key, source, shown), key)
    drawn = random_pairs(rows.sparkSession, pairs, max(1, rows.count()), seed)
    j = drawn.join(end.select(F.col("number").alias("left"), F.col(source).alias("a"), F.col(shown).alias("sa")), "left").join(end.select(F.col("number").alias("right"), F.col(source).alias("b"), F.col(shown).alias("sb")), "right")
    return j.select(F.round(squared_distance(F.col("a"), F.col("b")), 6).alias("d"), F.round(squared_distance(F.col("sa"), F.col("sb")), 6).alias("e"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0

    return pairs.select(mean_rank(x).alias("rx"), mean_rank(y).alias("ry")).agg(F.corr("rx", "ry").alias("rho"))


def shape_balance(rows: DataFrame, axes: list[str]) -> float:
    """Smallest over largest eigenvalue of the covariance, which is axes x axes."""
    c = rows.agg(*[F.covar_samp(a, b).alias(f"{a}{b}") for a in axes for b in axes]).first()
    e = np.linalg.eigvalsh(np.array([c[i] for i in range(len(axes) ** 2)]).reshape(len(axes), -1))
    return float(e[0] / e[-1])
