"""Writers: Spark's commit protocol for tables, checks before anything is written, single documents from small results."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(*columns: str) -> Column:
    """One compact JSON text per row."""
    return F.to_json(F.struct(*columns))


def json_document(value, path: str) -> None:
    """A small value as one compact document: written beside the target, then renamed; sorted keys, NaN rejected."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header row; raises on an empty table."""
    if not df.head(1):
        raise ValueError("there is nothing to write")
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def labels(df: DataFrame, path: str, count: int, key: str = "paper_idx", label: str = "label") -> None:
    """Labels as SHORT, partitioned by lens if there are several; raises unless there are `count`, all from -1 to 32767."""
    bad = df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(label).between(-1, 32767), F.lit(False))).alias("bad")).first()
    if bad["n"] != count or bad["bad"]:
        raise ValueError(f"{bad['n']} labels, not {count}; {bad['bad']} out of range")
    out = df.withColumn(label, F.col(label).cast("short")).write.mode("overwrite")
    (out.partitionBy("lens_id") if "lens_id" in df.columns else out).parquet(path)


#: Shards that lie in one folder; a folder each would be millions of folders.
SHARDS_A_FOLDER = 5000


def shards(df: DataFrame, path: str, key: str = "paper_idx", size: int = 200) -> None:
    """Rows with their shard, chunk = `key` div `size`, in order of chunk and key. Folders hold SHARDS_A_FOLDER shards, so a
    reader of one (see shard) opens one folder and, by the statistics of its row groups, few of its rows."""
    out = df.withColumn("chunk", F.floor(F.col(key) / size).cast("long")).withColumn("folder", F.floor(F.col("chunk") / SHARDS_A_FOLDER).cast("int"))
    out.repartitionByRange("chunk").sortWithinPartitions("folder", "chunk", key).write.partitionBy("folder").mode("overwrite").parquet(path)


def shard(spark, path: str, chunk: int) -> DataFrame:
    """The rows of one shard."""
    return spark.read.parquet(path).where((F.col("folder") == chunk // SHARDS_A_FOLDER) & (F.col("chunk") == chunk)).drop("folder")


def neighbour_shards(neighbours: DataFrame, path: str, k: int, size: int = 200) -> None:
    """Neighbour lists packed into three bytes a number, a row per shard of `size` papers: (chunk, first, packed).
    neighbours: (paper_idx, n ARRAY). Raises if a list hasn't k members, a paper is there twice, or one is missing before
    the last; what the folder held before, expected or not, is replaced."""
    bad = neighbours.agg(F.count("*").alias("n"), F.count_distinct("paper_idx").alias("m"), F.max("paper_idx").alias("last"), F.count_if(F.coalesce(F.size("n"), F.lit(-1)) != k).alias("short")).first()
    if bad["short"] or bad["n"] != bad["m"] or bad["n"] and bad["n"] != bad["last"] + 1:
        raise ValueError(f"{bad['n']} lists of {bad['m']} papers up to {bad['last']}, {bad['short']} not of {k} numbers")
    one = neighbours.select(F.floor(F.col("paper_idx") / size).cast("long").alias("chunk"), F.struct("paper_idx", "n").alias("r"))
    rows = one.groupBy("chunk").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # at most `size` lists of k numbers
    packed = rows.select("chunk", (F.col("chunk") * size).alias("first"), uint24(F.flatten(F.transform("rs", lambda r: r["n"]))).alias("packed"))
    packed.repartitionByRange("chunk").write.mode("overwrite").parquet(path)


def uint24(values: Column) -> Column:
    """Numbers below 2^24 as little-endian bytes of three each, in hexadecimal."""
    one = lambda x: F.when((x >= 0) & (x < (1 << 24)), F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("int"), s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16)])).otherwise(F.raise_error(F.lit("a number doesn't fit into 24 bits")))
    return F.unhex(F.array_join(F.transform(values, one), ""))


def manifest(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rows, sha256): one digest of all texts in key order, from per-row digests.

    Digests are folded by chunks of keys first, so the last step only joins one digest per chunk.
    """
    rows = df.select(F.col(key).alias("k"), F.sha2(F.concat(F.col(key).cast("string"), F.lit("|"), F.coalesce(text, F.lit(""))), 256).alias("d"))
    fold = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda s: s[c]), ""), 256)
    chunk = rows.groupBy(F.floor(F.col("k") / 10_000).alias("g")).agg(F.count("*").alias("n"), fold("d").alias("d")).select(F.col("g").alias("k"), "n", "d")
    return chunk.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), fold("d").alias("sha256"))
