"""Cleaning, keys, terms, TF-IDF and coherence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import linkage as L
from ..operators import textstats as S
from ..session import cut
from ..tables import table
from .base import PAPERS_CTE, PERIOD_SQL, TYPE_SQL, YEAR_SQL, papers

STOP = ["the", "and", "for", "that", "with", "are", "this", "from", "not", "but"]


def clean_text(spark, sf):
    """Descriptions cleaned and cut to 80 characters; entities need a UDF, so there is no SQL."""
    m = table(spark, sf, "paper_metadata")
    return m.select("row_no", T.clean_text(F.col("description"), 80).alias("cleaned"))


def clean_text_plain(spark, sf):
    """The cleaning of titles without entities."""
    m = table(spark, sf, "paper_metadata").where(~F.coalesce(F.col("title"), F.lit("")).contains("&"))
    return m.select("row_no", T.clean_text(F.col("title")).alias("cleaned"))


def clean_date(spark, sf):
    return table(spark, sf, "paper_metadata").select("row_no", T.clean_date(F.col("pub_date")).alias("cleaned"))


def key_extraction(spark, sf):
    m = table(spark, sf, "paper_metadata").where("url <> '' AND paper_id <> ''")
    return m.select("row_no", T.last_segment(F.col("url")).alias("segment"), T.path_stem(F.concat(F.lit("/texts/"), "paper_id", F.lit(".txt"))).alias("stem"))


def default_records(spark, sf):
    """Papers with metadata where there is any: title falls back to the id, url to the canonical one."""
    s = table(spark, sf, "search_rows").groupBy("paper_idx", "paper_id").agg(F.max("title").alias("st"))
    p = papers(spark, sf).select("paper_id", F.col("title").alias("pt"), F.col("url").alias("pu"))
    return s.join(p, "paper_id", "left").select("paper_idx", F.coalesce(F.nullif("pt", F.lit("")), "paper_id").alias("title"), F.coalesce(F.nullif("pu", F.lit("")), F.concat(F.lit("https://papers.example.invalid/rec/"), "paper_id")).alias("url"))


def document_texts(spark, sf):
    p = papers(spark, sf)
    return p.select("paper_id", *[F.md5(T.document_text(F.col("title"), F.col("description"), s)).alias(s) for s in ("doubled", "separator", "sentence")])


def year_period_buckets(spark, sf):
    m = table(spark, sf, "paper_metadata")
    return m.select("row_no", T.year(F.col("pub_date")).alias("year"), T.period_code(F.col("pub_date")).cast("int").alias("period"))


def type_codes(spark, sf):
    return table(spark, sf, "paper_metadata").groupBy("pub_type", T.type_code(F.col("pub_type")).cast("int").alias("code")).agg(F.count("*").alias("n"))


def config_keys(spark, sf):
    """Parameters back from a configuration's name."""
    p = table(spark, sf, "part").select("p_partkey", F.format_string("pca%d_u%d_mcs%d_ms%d", F.lit(100), (F.col("p_size") % 30).cast("int"), F.col("p_size"), (F.col("p_partkey") % 15).cast("int")).alias("key"))
    part = lambda i: F.regexp_extract("key", r"^pca(\d+)_u(\d+)_mcs(\d+)_ms(\d+)$", i).cast("int")
    return p.select("p_partkey", "key", part(1).alias("pca"), part(2).alias("dims"), part(3).alias("min_size"), part(4).alias("min_samples"))


def dedupe_keep_longest(spark, sf):
    return papers(spark, sf).select("paper_id", "row_no", F.length(F.coalesce("description", F.lit(""))).alias("chars"))


def record_chunks(spark, sf):
    """Ordinal and shard of 200 of every paper."""
    s = table(spark, sf, "search_rows").select("paper_idx").distinct()
    return s.select("paper_idx", F.floor(F.col("paper_idx") / 200).cast("long").alias("chunk"))


def singular_forms(spark, sf):
    w = table(spark, sf, "search_rows").select(F.explode(S.word_list(F.col("title"))).alias("token")).distinct()
    return w.select("token", T.singular(F.col("token")).alias("single"))


def token_edits(spark, sf):
    """Title words one edit or swap apart."""
    w = table(spark, sf, "search_rows").select(F.explode(S.word_list(F.col("title"), 5)).alias("a")).distinct()
    return L.near_words(w, w.withColumnRenamed("a", "b")).where("a < b")


def phrase_rows(spark, sf):
    s = table(spark, sf, "search_rows").select("paper_idx", F.lower("title").alias("t")).distinct()
    return s.where(T.contains_phrase(F.col("t"), F.lit("moral luck"))).select("paper_idx")


def surnames(spark, sf):
    c = table(spark, sf, "paper_metadata").where("creator <> ''").select("creator").distinct()
    return c.select("creator", T.surname(F.col("creator")).alias("surname"))


def search_forms(spark, sf):
    return table(spark, sf, "search_rows").where("title IS NOT NULL").select("title").distinct().select("title", T.search_form(F.col("title")).alias("form"))


def colour_contrast(spark, sf):
    """Luminance, OKLab and contrast against white of one colour per part."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)).alias("colour"))
    l, a, b = N.oklab(F.col("colour"))
    return p.select("p_partkey", "colour", F.round(N.luminance(F.col("colour")), 6).alias("luminance"), F.round(N.contrast(F.col("colour"), F.lit("#ffffff")), 6).alias("contrast"), F.round(l, 6).alias("ok_l"), F.round(a, 6).alias("ok_a"), F.round(b, 6).alias("ok_b"))


def neighbour_counts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "many").when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_partkey").cast("string"), F.lit(".7"))).otherwise((-F.col("p_partkey")).cast("string")).alias("typed"))
    return p.select("p_partkey", N.neighbour_count(F.col("typed")).alias("k"))


def json_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("")).alias("none"))


def _docs(spark, sf):
    """Titles of the deduplicated papers with the export batch as class."""
    return cut(papers(spark, sf).select(F.col("paper_id").alias("doc"), "title", F.coalesce("export_batch", F.lit(0)).alias("label")))


def tokens_inverted_index(spark, sf):
    s = table(spark, sf, "search_rows").groupBy("paper_idx").agg(F.max("title").alias("title"))
    i = S.inverted_index(s, "paper_idx", S.word_list(F.col("title"), 4))
    return i.select("token", "part", F.concat_ws(",", F.transform("postings", lambda x: x.cast("string"))).alias("postings"), "df")


def _terms(spark, sf, min_df=5, max_df=0.42, features=40_000):
    docs = _docs(spark, sf)
    n = docs.count()
    tf = cut(S.counts(docs, "doc", S.ngrams(S.word_list(F.col("title"), 3, STOP))))
    v = S.bounded(tf, n, min_df, max_df, features)
    return docs, tf, v, n


def vocabulary_bounds(spark, sf):
    return _terms(spark, sf)[2]


def tfidf_weights(spark, sf):
    _, tf, v, n = _terms(spark, sf)
    return S.tfidf(tf, v, n).select("doc", "term", F.round("w", 8).alias("w"))


def tfidf_centroid_quality(spark, sf):
    """How well centroids of term weights tell the classes apart: fitted on some papers, judged on the others."""
    docs, tf, v, n = _terms(spark, sf)
    w = S.tfidf(tf, v, n)
    held = F.conv(F.substring(F.md5("doc"), 1, 2), 16, 10).cast("int") < 64
    labels = docs.select("doc", "label")
    q = S.class_quality(S.nearest_class(w, labels.where(held), S.term_centroids(w, labels.where(~held))))
    return q.select("documents", *[F.round(c, 6).alias(c) for c in ("accuracy", "cohesion_mean", "margin_mean", "margin_positive_pct")])


def tfidf_train_only(spark, sf):
    """Weights of held-out documents by a vocabulary fitted on the others."""
    docs = _docs(spark, sf)
    held = F.conv(F.substring(F.md5("doc"), 1, 2), 16, 10).cast("int") < 64
    train, test = docs.where(~held), docs.where(held)
    n = train.count()
    terms = S.word_list(F.col("title"), 3, STOP)
    v = S.bounded(S.counts(train, "doc", terms), n, 5, 0.85)
    return S.tfidf(S.counts(test, "doc", terms), v, n, sublinear=True).select("doc", "term", F.round("w", 8).alias("w"))


def tfidf_terms_by_class(spark, sf):
    docs, tf, v, n = _terms(spark, sf)
    c = S.class_terms(S.tfidf(tf, v, n), docs.select("doc", "label"))
    return c.select("label", "term", F.round("mean", 8).alias("mean"), F.col("place").cast("long").alias("place"))


def _topics(spark, sf, k=6):
    docs = _docs(spark, sf)
    tf = cut(S.counts(docs, "doc", F.array_distinct(S.word_list(F.col("title"), 4, STOP))))
    top = tf.join(docs.select("doc", F.col("label").alias("topic")), "doc").groupBy("topic", "term").agg(F.count("*").alias("n"))
    ranked = top.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where(F.col("place") <= k)
    return docs, tf, top, cut(ranked)


def npmi_smoothed(spark, sf):
    docs, tf, _, topics = _topics(spark, sf)
    return S.npmi_smoothed(tf, topics, docs.count()).select("topic", F.round("npmi", 8).alias("npmi"))


def npmi_strict(spark, sf):
    docs, tf, _, topics = _topics(spark, sf)
    return S.npmi_strict(tf, topics, docs.count()).select("topic", F.round("npmi", 8).alias("npmi"))


def topic_diversity(spark, sf):
    return S.diversity(_topics(spark, sf)[3]).select(F.round("diversity", 9).alias("diversity"))


def term_exclusivity(spark, sf):
    _, _, top, topics = _topics(spark, sf)
    p = top.select("topic", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("p"))
    return S.exclusivity(p, topics).select("topic", F.round("exclusivity", 8).alias("exclusivity"))


def topic_distribution(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * x.cast("double")).alias("q"))
    e = e.withColumn("s", F.aggregate("q", F.lit(0.0), lambda a, x: a + x)).select("vec_id", F.transform("q", lambda x: x / F.col("s")).alias("p"))
    return S.distribution_summary(e, "p", 8).select(F.round("mean_top", 6).alias("mean_top"), F.round("mean_entropy", 6).alias("mean_entropy"), F.round("usage_entropy", 6).alias("usage_entropy"), "active_topics")


def ordered_string_agg(spark, sf):
    """The five most frequent terms of each class in one string."""
    _, _, _, topics = _topics(spark, sf, 5)
    return topics.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]), "; ").alias("terms"))


_WORDS = lambda col, least: f"regexp_extract_all(lower(coalesce({col}, '')), '\\p{{L}}{{{least},}}')"
_STOPS = "(" + ", ".join(f"'{s}'" for s in STOP) + ")"
_D = f"WITH {PAPERS_CTE}, d AS (SELECT paper_id AS doc, title, coalesce(export_batch, 0) AS label FROM papers)"
_TF = f"""{_D}, w AS (SELECT doc, label, list_filter({_WORDS('title', 3)}, lambda x: x NOT IN {_STOPS}) AS w FROM d),
g AS (SELECT doc, unnest(w) AS term FROM w UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2),
tf AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM d),
v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= (SELECT n FROM n) * 0.42::DOUBLE ORDER BY uses DESC, term LIMIT 40000),
raw AS (SELECT doc, term, (1.0::DOUBLE + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN v USING (term) CROSS JOIN n),
wt AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw)
"""
_TOPIC = lambda k: f"""{_D}, tf AS (SELECT DISTINCT doc, label AS topic, unnest({_WORDS('title', 4)}) AS term FROM d), tf0 AS (SELECT * FROM tf WHERE term NOT IN {_STOPS}),
top AS (SELECT topic, term, count(*) AS n FROM tf0 GROUP BY ALL), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place FROM top) WHERE place <= {k}),
df AS (SELECT term, count(DISTINCT doc) AS df FROM tf0 GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM d),
pr AS (SELECT x.topic, x.term AS x, y.term AS y FROM tp x JOIN tp y ON x.topic = y.topic AND x.term < y.term),
bo AS (SELECT pr.topic, pr.x, pr.y, count(*) AS both_n FROM pr JOIN tf0 a ON a.term = pr.x JOIN tf0 b ON b.term = pr.y AND a.doc = b.doc GROUP BY ALL),
pp AS (SELECT pr.*, coalesce(both_n, 0) AS both_n, dx.df AS dx, dy.df AS dy, n FROM pr LEFT JOIN bo USING (topic, x, y) JOIN df dx ON dx.term = x JOIN df dy ON dy.term = y CROSS JOIN n)
"""  # noqa: E731
_LIN = lambda at: f"(CASE WHEN c{at} <= 0.04045 THEN c{at} / 12.92::DOUBLE ELSE pow((c{at} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"

QUERIES = {f.__name__: f for f in (
    clean_text, clean_text_plain, clean_date, key_extraction, default_records, document_texts, year_period_buckets, type_codes, config_keys, dedupe_keep_longest, record_chunks, singular_forms, token_edits,
    phrase_rows, surnames, search_forms, colour_contrast, neighbour_counts, json_fields, tokens_inverted_index, vocabulary_bounds, tfidf_weights, tfidf_centroid_quality, tfidf_train_only, tfidf_terms_by_class, npmi_smoothed, npmi_strict,
    topic_diversity, term_exclusivity, topic_distribution, ordered_string_agg,
)}
SQL = {
    "clean_text_plain": r"SELECT row_no, regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS cleaned FROM paper_metadata WHERE coalesce(title, '') NOT LIKE '%&%'",
    "clean_date": r"SELECT row_no, CASE WHEN regexp_full_match(trim(coalesce(pub_date, '')), '\d{4}\.0') THEN substr(trim(pub_date), 1, 4) ELSE substr(trim(coalesce(pub_date, '')), 1, 80) END AS cleaned FROM paper_metadata",
    "key_extraction": "SELECT row_no, string_split(url, '/')[-1] AS segment, regexp_extract('/texts/' || paper_id || '.txt', '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM paper_metadata WHERE url <> '' AND paper_id <> ''",
    "default_records": f"WITH {PAPERS_CTE} SELECT paper_idx, coalesce(nullif(p.title, ''), s.paper_id) AS title, coalesce(nullif(p.url, ''), 'https://papers.example.invalid/rec/' || s.paper_id) AS url FROM (SELECT DISTINCT paper_idx, paper_id FROM search_rows) s LEFT JOIN papers p USING (paper_id)",
    "document_texts": f"WITH {PAPERS_CTE}, x AS (SELECT paper_id, coalesce(title, '') AS t, coalesce(description, '') AS a FROM papers) SELECT paper_id, md5(t || '. ' || t || '. ' || a) AS doubled, md5(t || '[SEP]' || a) AS separator, md5(t || '. ' || a) AS sentence FROM x",
    "year_period_buckets": f"SELECT row_no, yr AS year, {PERIOD_SQL} AS period FROM (SELECT *, {YEAR_SQL.format('pub_date')} AS yr FROM paper_metadata)",
    "type_codes": f"SELECT pub_type, {TYPE_SQL} AS code, count(*) AS n FROM paper_metadata GROUP BY ALL",
    "config_keys": "SELECT p_partkey, 'pca100_u' || (p_size % 30) || '_mcs' || p_size || '_ms' || (p_partkey % 15) AS key, 100 AS pca, CAST(p_size % 30 AS INT) AS dims, CAST(p_size AS INT) AS min_size, CAST(p_partkey % 15 AS INT) AS min_samples FROM part",
    "dedupe_keep_longest": f"WITH {PAPERS_CTE} SELECT paper_id, row_no, CAST(length(coalesce(description, '')) AS INT) AS chars FROM papers",
    "record_chunks": "SELECT DISTINCT paper_idx, paper_idx // 200 AS chunk FROM search_rows",
    "singular_forms": f"""SELECT token, CASE WHEN length(token) >= 5 AND token LIKE '%ies' THEN left(token, length(token) - 3) || 'y' WHEN length(token) >= 5 AND regexp_matches(token, '(sses|shes|ches|xes|zes)$') THEN left(token, length(token) - 2)
 WHEN length(token) >= 4 AND token LIKE '%s' AND NOT regexp_matches(token, '(ss|us|is|ics)$') THEN left(token, length(token) - 1) ELSE token END AS single FROM (SELECT DISTINCT unnest({_WORDS('title', 3)}) AS token FROM search_rows)""",
    # by characters, as DuckDB's own edit distance counts bytes: one letter other in the same place, one less, or two swapped
    "token_edits": f"""WITH w AS (SELECT DISTINCT unnest({_WORDS('title', 5)}) AS t FROM search_rows), d AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM w),
 f AS (SELECT t, i, substr(t, 1, i - 1) || substr(t, i + 1) AS form, substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) AS swapped FROM d)
 SELECT x.t AS a, y.t AS b FROM f x JOIN f y ON x.i = y.i AND x.form = y.form AND x.t < y.t
 UNION SELECT least(f.t, w.t), greatest(f.t, w.t) FROM f JOIN w ON f.form = w.t
 UNION SELECT least(f.t, w.t), greatest(f.t, w.t) FROM f JOIN w ON f.swapped = w.t AND f.t <> w.t""",
    "phrase_rows": "SELECT DISTINCT paper_idx FROM search_rows WHERE ' ' || lower(title) || ' ' LIKE '% moral luck %'",
    "colour_contrast": f"""WITH x AS (SELECT p_partkey, '#' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS colour FROM part),
 y AS (SELECT *, CAST('0x' || substr(colour, 2, 2) AS INT) / 255.0::DOUBLE AS c1, CAST('0x' || substr(colour, 4, 2) AS INT) / 255.0::DOUBLE AS c2, CAST('0x' || substr(colour, 6, 2) AS INT) / 255.0::DOUBLE AS c3 FROM x),
 z AS (SELECT *, {_LIN(1)} AS r, {_LIN(2)} AS g, {_LIN(3)} AS b FROM y),
 q AS (SELECT *, cbrt(0.4122214708::DOUBLE * r + 0.5363325363::DOUBLE * g + 0.0514459929::DOUBLE * b) AS l, cbrt(0.2119034982::DOUBLE * r + 0.6806995451::DOUBLE * g + 0.1073969566::DOUBLE * b) AS m, cbrt(0.0883024619::DOUBLE * r + 0.2817188376::DOUBLE * g + 0.6299787005::DOUBLE * b) AS s, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS lum FROM z)
 SELECT p_partkey, colour, round(lum, 6) AS luminance, round(1.05::DOUBLE / (lum + 0.05::DOUBLE), 6) AS contrast, round(0.2104542553::DOUBLE * l + 0.7936177850::DOUBLE * m - 0.0040720468::DOUBLE * s, 6) AS ok_l,
 round(1.9779984951::DOUBLE * l - 2.4285922050::DOUBLE * m + 0.4505937099::DOUBLE * s, 6) AS ok_a, round(0.0259040371::DOUBLE * l + 0.7827717662::DOUBLE * m - 0.8086757660::DOUBLE * s, 6) AS ok_b FROM q""",
    "neighbour_counts": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 1 THEN greatest(1, least(50, p_partkey)) ELSE 1 END AS INT) AS k FROM part",
    "json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events",
    "tokens_inverted_index": f"WITH s AS (SELECT paper_idx, max(title) AS title FROM search_rows GROUP BY 1), t AS (SELECT DISTINCT paper_idx, unnest({_WORDS('title', 4)}) AS token FROM s) SELECT token, paper_idx // 1048576 AS part, string_agg(CAST(paper_idx AS VARCHAR), ',' ORDER BY paper_idx) AS postings, CAST(sum(count(*)) OVER (PARTITION BY token) AS BIGINT) AS df FROM t GROUP BY 1, 2",
    "vocabulary_bounds": _TF + "SELECT term, df, uses FROM v",
    "tfidf_weights": _TF + "SELECT doc, term, round(w, 8) AS w FROM wt",
    "tfidf_centroid_quality": _TF + """, h AS (SELECT doc, label, CAST('0x' || substr(md5(doc), 1, 2) AS INT) < 64 AS held FROM d),
 s AS (SELECT label, term, sum(w) AS s FROM wt JOIN h USING (doc) WHERE NOT held GROUP BY ALL), ce AS (SELECT label AS class, term, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS c FROM s),
 sc AS (SELECT doc, class, sum(w * c) AS score FROM wt JOIN ce USING (term) GROUP BY ALL),
 e AS (SELECT doc, label, class, round(coalesce(score, 0), 9) AS score FROM (SELECT doc, label FROM h WHERE held) CROSS JOIN (SELECT DISTINCT class FROM ce) LEFT JOIN sc USING (doc, class)),
 b AS (SELECT doc, label, max(score) FILTER (class = label) AS own, max(score) FILTER (class <> label) AS other, first(class ORDER BY score DESC, class) AS nearest FROM e GROUP BY ALL)
 SELECT count(*) AS documents, round(avg(CASE WHEN nearest = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(own), 6) AS cohesion_mean, round(avg(own - other), 6) AS margin_mean,
 round(avg(CASE WHEN own > other THEN 100.0::DOUBLE WHEN own <= other THEN 0 END), 6) AS margin_positive_pct FROM b""",
    "tfidf_train_only": f"""{_D}, h AS (SELECT doc, title, CAST('0x' || substr(md5(doc), 1, 2) AS INT) < 64 AS held FROM d),
 g AS (SELECT doc, held, unnest(list_filter({_WORDS('title', 3)}, lambda x: x NOT IN {_STOPS})) AS term FROM h), tf AS (SELECT doc, held, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM h WHERE NOT held),
 v AS (SELECT term, count(*) AS df FROM tf WHERE NOT held GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= (SELECT n FROM n) * 0.85::DOUBLE),
 raw AS (SELECT doc, term, (1.0::DOUBLE + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN v USING (term) CROSS JOIN n WHERE held)
 SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 8) AS w FROM raw""",
    "tfidf_terms_by_class": _TF + """, c AS (SELECT label, count(*) AS n FROM d GROUP BY 1), m AS (SELECT label, term, sum(w) / any_value(c.n) AS mean FROM wt JOIN d USING (doc) JOIN c USING (label) GROUP BY ALL)
 SELECT label, term, round(mean, 8) AS mean, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mean, 9) DESC, term) AS place FROM m) WHERE place <= 14""",
    "npmi_smoothed": _TOPIC(6) + "SELECT topic, round(avg(ln((both_n + 1) / (n + 1) / ((dx + 1) / (n + 1) * ((dy + 1) / (n + 1)))) / nullif(-ln((both_n + 1) / (n + 1)), 0)), 8) AS npmi FROM pp GROUP BY 1",
    "npmi_strict": _TOPIC(6) + "SELECT topic, round(avg(CASE WHEN both_n = 0 THEN -1.0::DOUBLE ELSE ln(both_n * n / (dx::DOUBLE * dy)) / nullif(-ln(both_n / n), 0) END), 8) AS npmi FROM pp GROUP BY 1",
    "topic_diversity": _TOPIC(6) + "SELECT round(count(DISTINCT term)::DOUBLE / count(*), 9) AS diversity FROM tp",
    "term_exclusivity": _TOPIC(6) + ", p AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS p FROM top), s AS (SELECT topic, term, p / sum(p) OVER (PARTITION BY term) AS share FROM p) SELECT topic, round(avg(share), 8) AS exclusivity FROM s JOIN tp USING (topic, term) GROUP BY 1",
    "topic_distribution": """WITH q AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings), p AS (SELECT vec_id, list_transform(q, lambda x: x / list_sum(q)) AS p FROM q),
 d AS (SELECT list_max(p) AS top, list_position(p, list_max(p)) AS topic, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(8.0) AS h FROM p), u AS (SELECT topic, count(*) / (SELECT count(*) FROM d)::DOUBLE AS s FROM d GROUP BY 1)
 SELECT round(avg(top), 6) AS mean_top, round(avg(h), 6) AS mean_entropy, round((SELECT -sum(s * ln(s)) / ln(8.0) FROM u), 6) AS usage_entropy, (SELECT count(*) FROM u) AS active_topics FROM d""",
    "ordered_string_agg": _TOPIC(5) + "SELECT topic, string_agg(term, '; ' ORDER BY place) AS terms FROM tp GROUP BY 1",
}
