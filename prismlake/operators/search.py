"""Ranked title and author search over an inverted index.

The index is a table (token, postings as rows, prefix, length); a query first picks, from the index alone, the query
token with the fewest rows, and only those rows are scored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, equivalent, one_edit, search_form, tokens, tokens_match

#: Score, tokens looked at, and what tokens_match may use, in the order of trial; the title phrase (1100) comes between.
TIERS = [
    (1150, "at", ""), (1050, "tt", ""), (950, "at", "pi"), (900, "tt", "p"), (850, "at", "pif"), (800, "tt", "pf"),
    (750, "ct", ""), (650, "ct", "pi"), (600, "ct", "pif"),
]


def query_form(text: str) -> str:
    """search_form for one string on the driver."""
    s = re.sub("[̀-ͯ’'`]", "", unicodedata.normalize("NFKD", text)).lower().replace("&", " and ")
    return " ".join(re.sub(r"[\W_]+", " ", s).split())


def prepare(rows: DataFrame, key: str, title: str, authors: str) -> DataFrame:
    """(row, title, authors, tt, at, ct): searchable forms and their tokens."""
    p = rows.select(F.col(key).alias("row"), search_form(F.col(title)).alias("title"), search_form(F.col(authors)).alias("authors"))
    p = p.withColumn("tt", tokens(F.col("title"))).withColumn("at", tokens(F.col("authors")))
    return p.withColumn("ct", F.concat("tt", "at"))


def index(prepared: DataFrame) -> DataFrame:
    """(token, row): one row per posting, so that no list grows with the collection."""
    return prepared.select("row", F.explode(F.array_distinct("ct")).alias("token"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(token, n): the index's tokens and their rows; kept beside the index where that is a table."""
    return postings.groupBy("token").agg(F.count("*").alias("n"))


def direct_match(token: str) -> Column:
    """Tokens a query token stands for: equal, singular/plural or prefixed ones."""
    return F.col("token").startswith(token[:2]) & (equivalent(F.lit(token), F.col("token")) | F.col("token").startswith(token))


def near_match(token: str) -> Column:
    """Tokens one edit away; looked at from four letters on and only if there is no direct match."""
    if len(token) < 4:
        return F.lit(False)
    return F.length("token").between(max(4, len(token) - 1), len(token) + 1) & one_edit("_q", "token")


def vocabulary_matches(postings: DataFrame, token: str) -> DataFrame:
    """(token): what a query token stands for."""
    v = postings.select("token").distinct().withColumn("_q", F.lit(token))
    return v.where(direct_match(token) if v.where(direct_match(token)).head(1) else near_match(token)).select("token")


def rarest_part(words: DataFrame, parts: list[str]) -> tuple[int, Column, str] | None:
    """(postings, condition on tokens, part) of the query part with the fewest postings, from one pass over the vocabulary; None if a
    part stands for no token. One row comes to the driver."""
    counts = [F.struct(*[F.sum(F.when(c, F.col("n"))).alias(k) for k, c in (("direct", direct_match(p)), ("near", _near_to(i, p)))]).alias(f"p{i}") for i, p in enumerate(parts)]
    for i, p in enumerate(parts):
        words = words.withColumn(f"_q{i}", F.lit(p))
    got = words.agg(*counts).first()
    best = None
    for i, p in enumerate(parts):
        n, how = (got[f"p{i}"]["direct"], direct_match(p)) if got[f"p{i}"]["direct"] else (got[f"p{i}"]["near"], near_match(p))
        if not n:
            return None
        if best is None or n < best[0]:
            best = n, how, p
    return best


def _near_to(i: int, token: str) -> Column:
    if len(token) < 4:
        return F.lit(False)
    return F.length("token").between(max(4, len(token) - 1), len(token) + 1) & one_edit(f"_q{i}", "token")


def score(query: str, parts: list[str]) -> Column:
    """The tier of a prepared row, plus the number of query tokens in the token tiers; -1 if it doesn't match.

    The phrase tiers are built-in; one UDF tries the token tiers, and only on the rows that get there.
    """
    n = len(parts)

    @F.pandas_udf("int")
    def tier(title_tokens: pd.Series, author_tokens: pd.Series, phrase: pd.Series) -> pd.Series:
        def one(t, a, p) -> int:
            sides = {"tt": list(t), "at": list(a), "ct": [*t, *a]}
            for value, where, mode in TIERS:
                if p and value < 1100:
                    return 1100
                if tokens_match(parts, sides[where], mode):
                    return value + n
            return -1

        return pd.Series([one(t, a, p) for t, a, p in zip(title_tokens, author_tokens, phrase)], dtype="int32")

    q = F.lit(query)
    return (
        F.when(F.col("title") == q, 1400).when(F.col("authors") == q, 1350).when(F.col("title").startswith(query), 1250)
        .when(F.col("authors").startswith(query), 1200).when(contains_phrase(F.col("authors"), q), 1175)
        .otherwise(tier("tt", "at", contains_phrase(F.col("title"), q)))
    )


def search(prepared: DataFrame, postings: DataFrame, query: str, limit: int = 8, words: DataFrame | None = None) -> DataFrame:
    """(row, score) of the best rows by score, then row. words: vocabulary(postings), if it is kept.

    A matching row holds a token for every part of the query, so only the rows of the rarest part are scored.
    """
    q = query_form(query)
    parts = q.split()
    empty = prepared.select("row", F.lit(0).alias("score")).limit(0)
    if len(q) < 2 or limit <= 0 or not any(len(p) >= 2 for p in parts):
        return empty
    words = vocabulary(postings) if words is None else words
    best = rarest_part(words, [p for p in parts if len(p) >= 2])
    if best is None:
        return empty
    _, condition, part = best
    rows = postings.withColumn("_q", F.lit(part)).where(condition).select("row").distinct()
    found = prepared.join(rows, "row", "left_semi").withColumn("score", score(q, parts)).where("score >= 0")
    return found.select("row", "score").orderBy(F.desc("score"), "row").limit(limit)


def write_index(rows: DataFrame, key: str, title: str, authors: str, path: str) -> None:
    """The searchable rows, the index ordered by token (so a query's tokens touch few row groups) and its vocabulary, as
    tables in a folder."""
    p = prepare(rows, key, title, authors)
    p.write.mode("overwrite").parquet(f"{path}/rows")
    spark = rows.sparkSession
    kept = spark.read.parquet(f"{path}/rows")
    index(kept).repartitionByRange("token").sortWithinPartitions("token", "row").write.mode("overwrite").parquet(f"{path}/postings")
    vocabulary(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/words")


def search_kept(spark, path: str, query: str, limit: int = 8) -> DataFrame:
    """search over the tables of write_index."""
    return search(*[spark.read.parquet(f"{path}/{x}") for x in ("rows", "postings")], query, limit, spark.read.parquet(f"{path}/words"))
