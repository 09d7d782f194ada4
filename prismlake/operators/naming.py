"""Names of topics and clusters from their leading terms. Terms are rows (group, place, term), place counted from 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sequence_ratio

#: Words written in capitals, the long form of one of them, likeness of words that say the same (with and
#: without a common start) and the least letters for that, joint, name of a group without terms.
CAPITALS = ["ai", "ocr", "vr"]
LONG_FORMS = {"ai": ["artificial", "intelligence"]}
LIKE_WITH_START, LIKE, START = 0.55, 0.68, 4
JOINT, NO_NAME = " · ", "Unlabelled topic"


def display_term(term: Column) -> Column:
    """Each word with a capital; acronyms whole."""
    return F.array_join(F.transform(F.split(term, " "), lambda w: F.when(w.isin(CAPITALS), F.upper(w)).otherwise(F.initcap(w))), " ")


def term_words(term: Column) -> Column:
    out = F.split(term, " ")
    for short, long in LONG_FORMS.items():
        out = F.when(term == short, F.array(*map(F.lit, long))).otherwise(out)
    return out


def same_meaning(pairs: DataFrame) -> DataFrame:
    """The pairs of words (x, y) that hardly differ: equal but for a plural s, or alike in their letters."""
    bare = lambda w: F.regexp_replace(w, "s$", "")
    least, ratio = F.least(F.length("x"), F.length("y")), F.col("ratio")
    start = F.least(F.lit(START), least)
    common = F.substring("x", F.lit(1), start) == F.substring("y", F.lit(1), start)
    close = (least >= START) & (ratio >= LIKE) | (least >= 3) & common & (ratio >= LIKE_WITH_START)
    return pairs.select("x", "y").distinct().withColumn("ratio", sequence_ratio("x", "y")).where((bare("x") == bare("y")) | close).select("x", "y")


def overlapping(terms: DataFrame) -> DataFrame:
    """(group, place): the terms that repeat a word of their group's first term."""
    words = terms.select("group", "place", F.explode(F.array_distinct(term_words(F.col("term")))).alias("y"))
    pairs = words.where("place = 1").select("group", F.col("y").alias("x")).join(words.where("place > 1"), "group")
    return pairs.join(same_meaning(pairs), ["x", "y"], "left_semi").select("group", "place").distinct()


def topic_names(terms: DataFrame) -> DataFrame:
    """(group, name): the first term and the first further one that doesn't overlap with it."""
    free = terms.join(overlapping(terms), ["group", "place"], "left_anti")
    two = free.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("place"))).where("n <= 2")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", display_term(F.col("term")).alias("t")))), lambda s: s["t"]), JOINT)
    return two.groupBy("group").agg(joined.alias("name"))


def unique_names(named: DataFrame, lens: str, group: str) -> DataFrame:
    """(lens, group, name) without a name twice in a lens. named: (lens, group, name, terms ARRAY of displayed terms).

    Groups choose in their order: the plain name, else the name with the first of the terms that makes it new; a group
    whose terms are all taken keeps the plain name. A lens has few groups, so each is one task.
    """
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(group, ignore_index=True)
        options = [[n, *(f"{n}{JOINT}{t}" for t in (() if ts is None else ts))] for n, ts in zip(rows["name"], rows["terms"])]
        used: set[str] = set()
        names = []
        for own in options:
            names.append(next((o for o in own if o not in used), own[0]))
            used.add(names[-1])
        return rows.assign(name=names)[[lens, group, "name"]]

    types = dict(named.dtypes)
    return named.groupBy(lens).applyInPandas(choose, f"`{lens}` {types[lens]}, `{group}` {types[group]}, name string")


def inherited_names(best: DataFrame, terms: DataFrame, least: float = 0.70) -> DataFrame:
    """(group, name): the best reference cluster's name if it is close enough, else the name from the terms; unique.
    best: (group, reference, jaccard); terms: (group, place, term)."""
    shown = terms.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", display_term(F.col("term")).alias("t")))), lambda s: s["t"]).alias("terms"))
    own = best.join(topic_names(terms), "group", "left").join(shown, "group", "left")
    plain = F.when(F.col("jaccard") >= least, F.col("reference")).otherwise(F.coalesce("name", F.lit(NO_NAME)))
    return unique_names(own.select(F.lit(0).alias("lens"), "group", plain.alias("name"), "terms"), "lens", "group").drop("lens")
