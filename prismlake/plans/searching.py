"""Search over titles and authors, and record linkage on the logged hits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import link_form
from ..operators import linkage as L
from ..operators import search as S
from ..session import cut, delete_on_exit, shared_dir
from ..tables import table

QUERY = "moral luck"


def _rows(spark, sf):
    return table(spark, sf, "search_rows").groupBy("paper_idx").agg(F.max("title").alias("title"), F.max("authors").alias("authors"))


def search_ranked(spark, sf):
    """The eight best rows for a typed query with a swapped letter and a plural; a top-k report."""
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    S.write_index(_rows(spark, sf), "paper_idx", "title", "authors", path)
    return S.search_kept(spark, path, "moral lukc", 8)


def search_phrase_tiers(spark, sf):
    """The tiers that need no token matching, for every row that holds the query as a phrase."""
    p = _rows(spark, sf).select(F.col("paper_idx").alias("row"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("authors", F.lit(""))).alias("authors"))
    q = QUERY
    s = F.when(F.col("title") == q, 1400).when(F.col("authors") == q, 1350).when(F.col("title").startswith(q), 1250).when(F.col("authors").startswith(q), 1200).when(F.concat(F.lit(" "), "title", F.lit(" ")).contains(f" {q} "), 1100)
    return p.withColumn("score", s).where("score IS NOT NULL").select("row", "score")


def search_vocabulary(spark, sf):
    """Index tokens that a query token reaches by prefix or number."""
    words = _rows(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("token"), F.col("paper_idx").alias("row"))
    return S.vocabulary_matches(words, "theori").select("token")


def search_candidates(spark, sf):
    """Rows of the query token with the fewest postings."""
    words = _rows(spark, sf).select(F.col("paper_idx").alias("row"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("token"))
    n = words.where(F.col("token").isin("moral", "luck", "the")).groupBy("token").agg(F.count("*").alias("n"))
    least = n.withColumn("place", F.row_number().over(Window.orderBy("n", "token"))).where("place = 1").select("token")
    return words.join(F.broadcast(least), "token").select("row", "token")


def _logged(spark, sf):
    return table(spark, sf, "enrichment_pilot")


def linkage_accept(spark, sf):
    """Strict and legacy acceptance of the logged hits."""
    p = _logged(spark, sf)
    strict = L.accepted(F.col("title_similarity"), F.col("author_match"), F.col("author_count"), F.col("source_year"), F.col("candidate_year"), L.type_compatible(F.col("source_type"), F.col("candidate_type")))
    legacy = L.accepted_legacy(F.col("title_similarity"), F.col("author_match"), F.col("source_year"), F.col("candidate_year"))
    return p.select("record_id", strict.alias("strict"), legacy.alias("legacy"), L.type_compatible(F.col("source_type"), F.col("candidate_type")).alias("compatible"))


def linkage_rates(spark, sf):
    """Counts and rates of acceptance by source type."""
    p = _logged(spark, sf).join(linkage_accept(spark, sf), "record_id")
    return p.groupBy("source_type").agg(
        F.count("*").alias("records"), F.count("candidate_title").alias("hits"), F.count_if("strict").alias("accepted"),
        F.round(F.count_if("strict") / F.count("*"), 6).alias("rate"), F.count_if(F.col("author_match")).alias("author_matches"),
    )


def linkage_precedence(spark, sf):
    """One hit per paper: an accepted Crossref one, else an accepted OpenAlex one, else none."""
    p = _logged(spark, sf).join(linkage_accept(spark, sf).select("record_id", "strict"), "record_id").where("strict")
    pick = lambda s: p.where(F.col("candidate_source") == s).groupBy("paper_id").agg(F.min("candidate_title").alias("title"))
    return L.precedence(pick("Crossref"), pick("OpenAlex"), "paper_id", "title")


def linkage_score(spark, sf):
    """The score recomputed from the logged parts."""
    p = _logged(spark, sf).where("title_similarity IS NOT NULL")
    return p.select("record_id", F.round(L.score(F.col("title_similarity"), F.col("author_match"), F.col("source_year"), F.col("candidate_year")), 4).alias("score"))


def linkage_scores(spark, sf):
    """Title ratio, author and year scored for each record and all works that share a title word, typed alike or nearly so."""
    p = _logged(spark, sf).select("record_id", "title", "creator", "source_year")
    w = cut(table(spark, sf, "candidate_works").dropDuplicates(["work_id"]).select("work_id", "candidate_title", "candidate_authors", "candidate_year"))  # read twice
    form = lambda title: F.filter(F.split(link_form(F.col(title)), " "), lambda x: x != "")
    rows = p.where("record_id IS NOT NULL").select("record_id", link_form(F.col("title")).alias("form"), F.col("source_year").alias("year"), F.array(F.coalesce(L.surname(F.col("creator")), F.lit(""))).alias("people"), form("title").alias("words"))
    words = rows.groupBy("record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")).where("size(words) > 0")
    rows = rows.drop("words").join(words, "record_id")
    alike = ["form", "year", "people", "words"]
    # records, and works, that can't be told apart are compared once
    records = cut(rows.withColumn("id", F.min("record_id").over(Window.partitionBy(*alike))))
    works = w.where("work_id IS NOT NULL").select("work_id", link_form(F.col("candidate_title")).alias("form"), F.col("candidate_year").alias("year"), L.family_names(F.col("candidate_authors")).alias("people"), F.array_sort(F.array_distinct(form("candidate_title"))).alias("words"))
    works = cut(works.where("size(words) > 0").groupBy(*alike).agg(F.min("work_id").alias("id")))
    found = L.promising(records.select("id", *alike).distinct(), works)
    ids = found.join(records.select(F.col("id").alias("record"), "record_id"), "record").select("record_id", F.col("work").alias("work_id")).distinct()
    pairs = ids.join(p, "record_id").join(w, "work_id")
    return L.best_candidate(pairs, "record_id", "title", "creator", "source_year", "candidate_title", "candidate_authors", "candidate_year", "work_id").select("record_id", "work_id", "score")


_COMPAT = "CASE source_type " + " ".join(f"WHEN '{k}' THEN t IN ({', '.join(repr(x) for x in v)})" for k, v in L.COMPATIBLE.items()) + " ELSE false END"
_ACC = f"""WITH p AS (SELECT *, coalesce({_COMPAT}, false) AS compatible, (source_year IS NULL OR candidate_year IS NULL OR abs(source_year - candidate_year) <= 2) AS year_ok
 FROM (SELECT *, lower(replace(candidate_type, ' ', '-')) AS t FROM enrichment_pilot)),
a AS (SELECT *, coalesce(title_similarity >= 0.94 AND (coalesce(author_match, false) OR (coalesce(author_count, 0) = 0 AND title_similarity = 1 AND coalesce(source_year = candidate_year, false))) AND year_ok AND compatible, false) AS strict,
 coalesce(title_similarity >= 0.94 AND (coalesce(author_match, false) OR title_similarity >= 0.985) AND year_ok, false) AS legacy FROM p)
"""
_R = "(SELECT paper_idx, max(title) AS title, max(authors) AS authors FROM search_rows GROUP BY 1)"

QUERIES = {f.__name__: f for f in (search_ranked, search_phrase_tiers, search_vocabulary, search_candidates, linkage_accept, linkage_rates, linkage_precedence, linkage_score, linkage_scores)}
SQL = {
    "search_phrase_tiers": f"""SELECT * FROM (SELECT paper_idx AS row, CASE WHEN t = '{QUERY}' THEN 1400 WHEN a = '{QUERY}' THEN 1350 WHEN starts_with(t, '{QUERY}') THEN 1250 WHEN starts_with(a, '{QUERY}') THEN 1200
 WHEN ' ' || t || ' ' LIKE '% {QUERY} %' THEN 1100 END AS score FROM (SELECT paper_idx, lower(coalesce(title, '')) AS t, lower(coalesce(authors, '')) AS a FROM {_R})) WHERE score IS NOT NULL""",
    "search_vocabulary": f"SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(title), '\\p{{L}}{{2,}}')) AS token FROM {_R}) WHERE token LIKE 'theori%' OR token IN ('theori', 'theoris')",
    "search_candidates": f"""WITH w AS (SELECT DISTINCT paper_idx AS row, unnest(regexp_extract_all(lower(title), '\\p{{L}}{{2,}}')) AS token FROM {_R})
 SELECT row, token FROM w WHERE token = (SELECT token FROM w WHERE token IN ('moral', 'luck', 'the') GROUP BY 1 ORDER BY count(*), token LIMIT 1)""",
    "linkage_accept": _ACC + "SELECT record_id, strict, legacy, compatible FROM a",
    "linkage_rates": _ACC + "SELECT source_type, count(*) AS records, count(candidate_title) AS hits, count(*) FILTER (strict) AS accepted, round(count(*) FILTER (strict)::DOUBLE / count(*), 6) AS rate, count(*) FILTER (author_match) AS author_matches FROM a GROUP BY 1",
    "linkage_precedence": _ACC + """, c AS (SELECT paper_id, min(candidate_title) FILTER (candidate_source = 'Crossref') AS v1, min(candidate_title) FILTER (candidate_source = 'OpenAlex') AS v2 FROM a WHERE strict GROUP BY 1)
 SELECT paper_id, coalesce(v1, v2) AS title, CASE WHEN v1 IS NOT NULL THEN 1 ELSE 2 END AS used FROM c""",
    "linkage_score": """SELECT record_id, round(title_similarity * 0.84::DOUBLE + CASE WHEN author_match THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN abs(source_year - candidate_year) <= 1 THEN 0.06::DOUBLE ELSE 0 END, 4) AS score
 FROM enrichment_pilot WHERE title_similarity IS NOT NULL""",
}
