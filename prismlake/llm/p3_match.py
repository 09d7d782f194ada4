"""Problem 3: match records of two tables that share no key, each match with a confidence.

A cascade of rules, strongest first. Each rule is an exact join on a weaker combination of attributes (title, piece of
the title, main title, author word, start or end of an author word, all author words, year), followed by checks of
title, authors and years on the joined pairs only. What a rule resolves is taken out before the next one: a record can
be one work in each provider, so the unit that is resolved is (record, provider); records resolved in every provider
leave before their keys are made, units that are resolved leave before their pairs are judged. Several records may be
one work, as papers are drawn twice.

The joins carry 64-bit keys and ids only, hot keys are split (`hot.split_join`), and the texts of the surviving pairs
are fetched once. A piece of a title of n words is its first s and last e words, s + e = 2n/3: whatever single word was
typed wrong, left out or added, one of three pieces lacks it, so two titles one word apart share a piece.

A rule's confidence is its precision over the pairs that the logged search hits label, smoothed by PRIOR_WEIGHT pairs
of PRIOR. Labels come from accepted hits only (the log's own authors and title agree): the hit in the pair's provider
is this work, by title and year, or it is another. So a label says nothing about whether the pair's names or titles
agree, which the rules demand.

Defined results: records or works with null or empty title match nothing; a work without authors matches only on title
and year; years are free if one is missing and at most two apart otherwise; of repeated ids the smallest row counts;
ties in one pass go to the smaller year distance, then the better authors and title, then the smaller work_id; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, keep
from ..tables import table
from . import names
from .hot import hot_buckets, split_join

MAX_YEARS = 2
PRIOR, PRIOR_WEIGHT = 0.8, 5.0
#: Likeness of titles from which on the log's hit counts as accepted, if its authors agreed too.
ACCEPTED = 0.9
#: Words of a title that make another publication of it.
PARTS = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "part", "teil", "erratum", "corrigendum", "correction", "review", "reply", "comments", "response", "critical", "notice", "errata", "addendum"}
FREE = {"a", "an", "the", "of", "and", "article"}
KEYED = "tkey string, mains array<int>, who array<string>, pieces array<long>, tops array<string>"
#: Attributes to join on, from what keyed() gives, and whether they give a key per member.
ATTRIBUTES = {
    "title": ("tkey", False),
    "year": ("year", False),
    "piece": ("pieces", True),
    "main title": ("array_distinct(concat(array(tkey), transform(mains, n -> array_join(slice(split(tkey, ' '), 1, n), ' '))))", True),
    "author word": ("filter(array_distinct(split(array_join(who, ' '), ' ')), x -> x <> '')", True),
    "heaviest word": ("tops", True),
    "end of a word": ("array_distinct(flatten(transform(tops, x -> array(concat(left(x, 3), '-'), concat('-', right(x, 3))))))", True),
    "all author words": ("array_distinct(transform(who, x -> array_join(array_sort(split(x, ' ')), ' ')))", True),
    "long word": ("transform(slice(reverse(array_sort(transform(array_distinct(split(tkey, ' ')), x -> struct(length(x) AS n, x AS x)))), 1, 3), s -> s.x)", True),
}


def title_words(title: str) -> tuple[list[str], list[int]]:
    """Words of a title without markup, accents and case, and how many of them stand before each place where a subtitle
    may begin."""
    import html
    import re

    s = re.sub(r"<[^<>]{1,20}>", "", html.unescape(html.unescape(title)))
    s = re.sub(r"\[(?:[^\[\]]{0,12})\]\s*\*?\s*$", " ", s)
    s = names.plain(s).replace("&", " and ")
    s = re.sub(r"['’`´]", "", s)
    parts = [re.findall(r"[^\W_]+", x) for x in re.split(r"[:.–—?]\s|\s[-–—]\s|[:.?]$", s)]
    before = [sum(len(x) for x in parts[:i]) for i in range(1, len(parts))]
    words = [x for part in parts for x in part]
    return words, sorted({n for n in before if 0 < n < len(words)})


def pieces(words: list[str]) -> set[str]:
    """The title without blanks and, from three words on, its pieces: the first s and the last e words."""
    n, out = len(words), {"".join(words)}
    if n >= 3:
        for m in {2 * n // 3, 2 * (n - 1) // 3} - {0, 1}:
            for s in (0, m // 2, m):
                out.add(" ".join(words[:s]) + "|" + " ".join(words[n - (m - s) :]))
    return out


def name_weight():
    """A word's weight in a name before anything is counted: given names of the table weigh little, long words more."""
    given = set(names.SHORT) | {x for v in names.SHORT.values() for x in v}
    return lambda w: 1.0 if w in given else 3.0 + len(w) / 100


def keyed(rows: DataFrame, key: str, people: str) -> DataFrame:
    """rows (key, title, people, ...) without title, with tkey (the title's words), mains (words before a subtitle), who (the full words of
    each name), pieces and tops (each name's heaviest word); one row per key, the smallest, and none without words in the title.
    Kept as a table, as every rule reads it."""
    columns = [c for c in rows.columns if c != "title"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        weight = name_weight()
        number = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
        for pdf in batches:
            out: dict[str, list] = {"tkey": [], "mains": [], "who": [], "pieces": [], "tops": []}
            for t, p in zip(pdf["title"], pdf[people]):
                w, mains = title_words(t or "")
                who = [x for x in (names.parse(part)[1] for part in (p or "").split(";")) if x]
                out["tkey"].append(" ".join(w))
                out["mains"].append(mains)
                out["who"].append([" ".join(x) for x in who])
                out["pieces"].append(sorted(map(number, pieces(w))))
                out["tops"].append(sorted({max(x, key=lambda y: (weight(y), y)) for x in who}))
            yield pdf[columns].assign(**out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    found = rows.mapInPandas(run, f"{fields}, {KEYED}").where("tkey <> ''")
    return keep(found.groupBy(key).agg(F.min(F.struct(*[c for c in found.columns if c != key])).alias("m")).select(key, "m.*"))[0]


def title_relation(a: list[str], b: list[str]) -> int:
    """3 equal, 2 equal but for words typed wrong, 1 some words of a are missing in b, 0 else."""
    import difflib

    if a == b:
        return 3
    typed = missing = 0
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x, y = a[i1:i2], b[j1:j2]
        if op == "equal":
            continue
        if "".join(x) == "".join(y):
            typed += 1
        elif len(x) == len(y):
            for p, q in zip(x, y):
                limit = 1 if min(len(p), len(q)) < 6 else 2
                if p in PARTS or q in PARTS or p.isdigit() or q.isdigit() or min(len(p), len(q)) < 3 and not {p, q} <= FREE | {"l", "d"} or names.osa(p, q, limit) > limit:
                    return 0
                typed += 1
        elif not y and not any(w in PARTS or w.isdigit() for w in x):
            missing += len(x)
        elif not x and all(w in FREE for w in y):
            missing += 1
        elif x and y and abs(len(x) - len(y)) == 1 and names.osa("".join(x), "".join(y), 2) <= 2:
            typed += 1
        else:
            return 0
    if typed > 2 or missing > 1 or typed + missing > 2 or len(a) < 3:
        return 0
    return 1 if missing else 2


def author_relation(creator: str, people: str | None, parse) -> tuple[int, int]:
    """names.compare_people over the work's authors, the best, and how many words that author has in common with the
    creator; (-1, 0) if the work has no authors."""
    if not people or not people.strip():
        return -1, 0
    org, fa, ia, wa = parse(creator or "")
    best = names.NO, 0
    for one in people.split(";"):
        o, fb, ib, wb = parse(one)
        rel = names.NO
        if o and org:
            rel = names.compare_orgs(fa, [1.0] * len(fa), fb, [1.0] * len(fb))
        elif not o and not org:
            rel = names.compare_people(fa, ia, wa, fb, ib, wb)[0]
        best = max(best, (rel, len(set(fa) & set(fb))))
    return best


def main_relation(a: list[str], b: list[str], mains_a: list[int], mains_b: list[int]) -> bool:
    """Whether one title is a main part of the other, which goes on with a subtitle and not with "Part II" or the like."""
    long, short, mains = (a, b, mains_a) if len(a) > len(b) else (b, a, mains_b)
    if len(short) < 3 or len(short) not in mains or long[: len(short)] != short:
        return False
    rest = long[len(short) :]
    return len(rest) > 2 or not any(w in PARTS or w.isdigit() for w in rest)


def judged(pairs: DataFrame) -> DataFrame:
    """(record_id, work_id, provider, years, title_rel, main_rel, author_rel, author_words) of joined pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, known = name_weight(), {}

        def parse(value: str):
            if (found := known.get(value)) is None:
                if len(known) > 50_000:
                    known.clear()
                org, full, initials = names.parse(value)
                found = known[value] = org, full, initials, [weight(w) for w in full]
            return found

        for pdf in batches:
            words = [(a.split(" "), b.split(" ")) for a, b in zip(pdf["rt"], pdf["wt"])]
            rel = [title_relation(a, b) for a, b in words]
            main = [int(main_relation(a, b, c, d)) for (a, b), c, d in zip(words, pdf["rm"], pdf["wm"])]
            who = [author_relation(a, b, parse) for a, b in zip(pdf["creator"], pdf["people"])]
            yield pdf[["record_id", "work_id", "provider", "years"]].assign(title_rel=rel, main_rel=main, author_rel=[x for x, _ in who], author_words=[n for _, n in who])

    return pairs.mapInPandas(run, "record_id long, work_id long, provider string, years int, title_rel int, main_rel int, author_rel int, author_words int")


#: name, columns joined on (arrays are exploded), condition on works, condition on the judged pair (years: distance,
#: null if one is missing).
AUTHOR = "author_rel > 0"
NEAR_YEAR = f"(years IS NULL OR years <= {MAX_YEARS})"
RULES = [
    ("title, author word, year", ["title", "author word", "year"], None, f"title_rel = 3 AND {AUTHOR} AND years = 0"),
    ("title, author word", ["title", "author word"], None, f"title_rel = 3 AND {AUTHOR} AND {NEAR_YEAR}"),
    ("title, year", ["title", "year"], None, f"title_rel = 3 AND years = 0 AND ({AUTHOR} OR author_rel = -1)"),
    ("piece of the title, heaviest author word", ["piece", "heaviest word"], None, f"title_rel > 0 AND {AUTHOR} AND {NEAR_YEAR}"),
    ("piece of the title, year, no authors", ["piece", "year"], "size(who) = 0", "title_rel >= 2 AND author_rel = -1 AND years = 0"),
    ("main title, author word", ["main title", "author word"], None, f"main_rel = 1 AND {AUTHOR} AND {NEAR_YEAR}"),
    ("piece of the title, end of the heaviest author word", ["piece", "end of a word"], None, f"title_rel > 0 AND {AUTHOR} AND {NEAR_YEAR}"),
    ("all author words, a long title word", ["all author words", "long word"], None, f"title_rel > 0 AND {AUTHOR} AND {NEAR_YEAR}"),
]


def _keys(df: DataFrame, attributes: list[str], *keep: str) -> DataFrame:
    """(key, keep...): one row per combination of the attributes; an empty or null one gives none."""
    on = []
    for i, a in enumerate(attributes):
        value, several = ATTRIBUTES[a]
        df = df.withColumn(f"_k{i}", F.explode(F.expr(value)) if several else F.expr(value))
        on.append(f"_k{i}")
    return df.where(" AND ".join(f"{c} IS NOT NULL" for c in on)).select(F.xxhash64(*on).alias("key"), *[F.expr(c) for c in keep])


def cascade(records: DataFrame, works: DataFrame, rules=RULES) -> DataFrame:
    """(record_id, work_id, provider, rule).

    records: record_id, title, creator, year; works: work_id, title, people, year, provider.
    """
    spark = records.sparkSession
    r = keyed(records, "record_id", "creator")
    w = keyed(works, "work_id", "people")
    providers = w.select("provider").distinct().count()
    texts = r.select("record_id", F.col("tkey").alias("rt"), F.col("mains").alias("rm"), "creator")
    others = w.select("work_id", F.col("tkey").alias("wt"), F.col("mains").alias("wm"), "people", "provider")
    sides = []
    for _, attributes, only, _ in rules:
        sides.append((_keys(r, attributes), _keys(w.where(only) if only else w, attributes)))
    hot = hot_buckets(sides)
    found = spark.createDataFrame([], "record_id long, work_id long, provider string, rule int")
    for n, (_, attributes, only, condition) in enumerate(rules):
        done = found.groupBy("record_id").agg(F.collect_list("provider").alias("done"))  # a record has one row a provider
        left = r.join(done, "record_id", "left").where(F.coalesce(F.size("done"), F.lit(0)) < providers) if n else r.withColumn("done", F.array().cast("array<string>"))
        a = _keys(left, attributes, "record_id", "year AS ry", "done")
        b = _keys(w.where(only) if only else w, attributes, "work_id", "year AS wy", "provider")
        pairs = split_join(a, b, "record_id", "work_id", hot[n]).withColumn("years", F.abs(F.col("ry") - F.col("wy")))
        pairs = pairs.where(NEAR_YEAR).where("done IS NULL OR NOT array_contains(done, provider)").select("record_id", "work_id", "years")
        pairs = pairs.repartition("record_id").distinct().join(texts, "record_id").join(others, "work_id")
        best = Window.partitionBy("record_id", "provider").orderBy(F.coalesce("years", F.lit(9)), F.desc("author_rel"), F.desc("author_words"), F.desc("title_rel"), "work_id")
        hits = judged(pairs).where(condition).withColumn("place", F.row_number().over(best))
        found = cut(found.unionByName(hits.where("place = 1").select("record_id", "work_id", "provider", F.lit(n).alias("rule"))))
    return found


def confidences(found: DataFrame, records: DataFrame, works: DataFrame) -> DataFrame:
    """(rule, labelled, right_ones, confidence): smoothed precision of each rule over the pairs that the log labels."""
    log = records.where((F.col("log_title").isNotNull()) & F.col("log_author") & (F.col("log_similarity") >= ACCEPTED) & ~F.isnan("log_similarity"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    pairs = found.join(log.select("record_id", plain("log_title").alias("lt"), "log_year", F.col("log_source").alias("provider")), ["record_id", "provider"])
    pairs = pairs.join(works.select("work_id", plain("title").alias("wt"), F.col("year").alias("wy")), "work_id")
    same = (F.col("lt") == F.col("wt")) & F.coalesce(F.col("log_year") == F.col("wy"), F.lit(True))
    return (
        pairs.groupBy("rule").agg(F.count("*").alias("labelled"), F.count_if(same).alias("right_ones"))
        .withColumn("confidence", (F.col("right_ones") + PRIOR * PRIOR_WEIGHT) / (F.col("labelled") + PRIOR_WEIGHT))
    )


def year_of(text: Column) -> Column:
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when(y != "", y.cast("int"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "enrichment_pilot").where("record_id IS NOT NULL").select(
        "record_id", "title", "creator", F.coalesce("source_year", year_of(F.col("pub_date"))).alias("year"),
        F.col("candidate_title").alias("log_title"), F.col("candidate_year").alias("log_year"), F.col("candidate_source").alias("log_source"), F.col("author_match").alias("log_author"), F.col("title_similarity").alias("log_similarity"),
    )
    w = table(spark, sf_dir, "candidate_works").where("work_id IS NOT NULL").select(
        "work_id", F.col("candidate_title").alias("title"), F.col("candidate_authors").alias("people"), F.col("candidate_year").alias("year"), F.coalesce("provider", F.lit("")).alias("provider"),
    )
    return p, w


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, w = _inputs(spark, sf_dir)
    found = cascade(p.select("record_id", "title", "creator", "year"), w)
    conf = confidences(found, p, w)
    rule = F.create_map(*[x for i, (name, *_) in enumerate(RULES) for x in (F.lit(i), F.lit(name))])
    return found.join(F.broadcast(conf), "rule", "left").select(
        "record_id", "work_id", rule[F.col("rule")].alias("rule"), F.round(F.coalesce("confidence", F.lit(PRIOR)), 6).alias("confidence")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, w = _inputs(spark, sf_dir)
    return cascade(p.select("record_id", "title", "creator", "year"), w).select("record_id", "work_id")


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches}
SQL = {}
