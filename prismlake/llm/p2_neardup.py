"""Problem 2: records that repeat another's words with small edits, at any size of the collection.

1. A record is the set of the 32-bit hashes of its distinct words. Records with equal sets form a class; only one
   representative of each class goes on, so a group of copies, however large, costs one row.
2. The fingerprint of a set is 156 min-wise components (the smallest value of 156 hash functions over the set): two
   sets agree in a component with a probability equal to their similarity. It is split into 26 blocks of 6. By the
   pigeonhole principle pairs that differ in fewer than 26 components must share a block; a pair at similarity 0.75
   shares one with probability 0.994, at 0.80 with 0.9996, at 0.85 with over 0.99999.
3. Join on equal blocks. Block values of one record leave after a count; values of many records are split into cells
   of at most CELL records by salting, so no task holds a whole hot value. Pairs must differ in at most MAX_HAMMING of
   the 128 low-order bits of the fingerprint (expected 16 at similarity 0.75, 45 at 0.3).
4. The survivors' similarity is then computed from the word sets and held against the threshold.

A 64-bit SimHash was tried on paper first: at a word similarity of 0.75 two of them differ in 11 bits on average, so
pigeonhole blocks would be 3 bits wide and select nothing; min-wise components keep the blocks selective.

Defined results: null or empty texts have too few words and are in no pair; rows with a null id are left out; repeated
rows of an id count once (the largest title and text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, keep
from ..tables import table

THRESHOLD = 0.75
MIN_WORDS = 60
BLOCKS, ROWS = 26, 6
SKETCH_BITS = 128
MAX_HAMMING = 36
CELL = 2000
SEED = 20240117


def words(text: Column) -> Column:
    """Words in order: maximal runs of letters or digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fingerprint_batches(batches: Iterator[pd.DataFrame], blocks: int = BLOCKS, rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """(id, w) -> (id, keys, s0, s1): a 64-bit key of each block, and the low bits of the first 128 components."""
    k = blocks * rows
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, size=k, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size=k, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, size=rows, dtype=np.uint64) | np.uint64(1)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for pdf in batches:
        keys, s0, s1 = [], [], []
        lists = pdf["w"].tolist()
        for at in range(0, len(lists), 256):
            part = lists[at : at + 256]
            flat = np.concatenate(part).view(np.uint32).astype(np.uint64)
            uniq, where = np.unique(flat, return_inverse=True)
            with np.errstate(over="ignore"):
                h = ((uniq[:, None] * a + b) >> np.uint64(32)).astype(np.uint32)
                starts = np.concatenate(([0], np.cumsum([len(x) for x in part])[:-1]))
                sig = np.minimum.reduceat(h[where], starts, axis=0).astype(np.uint64)
                cells = sig.reshape(len(part), blocks, rows)
                key = (cells * mix).sum(axis=2, dtype=np.uint64) ^ (cells[:, :, 0] << np.uint64(31))
                key = (key + np.arange(1, blocks + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                low = sig[:, :SKETCH_BITS] & np.uint64(1)
                s0.append((low[:, :64] * powers).sum(axis=1, dtype=np.uint64).view(np.int64))
                s1.append((low[:, 64:128] * powers[: low.shape[1] - 64]).sum(axis=1, dtype=np.uint64).view(np.int64))
            keys.extend(key.view(np.int64))
        if lists:
            yield pd.DataFrame({"id": pdf["id"], "keys": keys, "s0": np.concatenate(s0), "s1": np.concatenate(s1)})


def block_pairs(prints: DataFrame, cell: int = CELL, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """(a, b), a < b: the pairs that share a block and lie within the Hamming distance."""
    rows = prints.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    live = rows.join(shared, "key").join(prints.select("id", "s0", "s1"), "id")
    left = live.select("key", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"), F.col("id").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    right = live.select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("id").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    distance = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    return left.join(right, ["key", "cell"]).where((F.col("a") < F.col("b")) & (distance <= max_hamming)).select("a", "b").distinct()


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """records: (id, w ARRAY<INT> of distinct word hashes). Gives (members: id, rep) and (links: a, b, similarity),
    the links between representatives of different classes; members of one class have similarity 1."""
    keyed = records.where(F.size("w") > 0).select("id", F.sort_array("w").alias("w")).select("id", "w", F.xxhash64("w").alias("k"), F.size("w").alias("n"))
    keyed = keep(keyed)[0]
    reps = keyed.groupBy("k", "n").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "k", "n").join(reps, ["k", "n"]).select("id", "rep")
    # each record carries its own words, so a class's words come from the representative's row alone
    sets = keyed.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "w")
    prints = cut(sets.mapInPandas(fingerprint_batches, "id long, keys array<long>, s0 long, s1 long"))
    cand = block_pairs(prints)
    a, b = sets.select(F.col("id").alias("a"), F.col("w").alias("wa")), sets.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    links = (
        cand.join(a, "a").join(b, "b")
        .withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: links expanded to the members of both classes, and the pairs inside each class."""
    both = links.select("a", "b").unionAll(members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    pairs = both.join(left, "a").join(right, "b").where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def papers(spark: SparkSession, sf_dir: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, w) of the papers whose abstract has at least min_words words; w: hashes of the words of title and abstract."""
    s = table(spark, sf_dir, "search_rows").select(F.col("paper_idx").alias("id"), "title", F.lit(None).cast("string").alias("abstract"))
    d = table(spark, sf_dir, "detail_rows").select(F.col("paper_idx").alias("id"), F.lit(None).cast("string").alias("title"), "abstract")
    one = s.unionAll(d.where(F.length("abstract") >= 2 * min_words - 1)).where("id IS NOT NULL").groupBy("id").agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"))
    body = one.where("abstract IS NOT NULL").select("id", "title", words(F.col("abstract")).alias("body")).where(F.size("body") >= min_words)
    return body.select("id", F.transform(F.array_distinct(F.concat("body", words(F.col("title")))), lambda x: F.hash(x)).alias("w"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(papers(spark, sf_dir))
    return all_pairs(members, links).select(F.col("a").alias("paper_idx_a"), F.col("b").alias("paper_idx_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper of a group: its class (smallest paper_idx of equal word sets), its group and links of its class."""
    from .components import components

    members, links = near_duplicates(papers(spark, sf_dir))
    links = cut(links)
    groups = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sized = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return (
        members.join(sized, "rep").join(degree, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .where("copies > 1 OR links > 0")
        .select(F.col("id").alias("paper_idx"), F.col("rep").alias("class_idx"), F.coalesce("component", "rep").alias("group_idx"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL = {}
