"""Papers, lenses and labels of the test tables, in Spark and as SQL that other plans build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import period_code, type_code
from ..tables import table

#: lens_id, algorithm, ordinal, name
LENSES = [("batch", "hdbscan", 0, "Export batch"), ("subject", "kmeans", 1, "Subject field"), ("type", "metadata", 2, "Publication type"), ("period", "metadata", 3, "Publication period")]
SUBJECTS = ["Philosophy of Law", "Philosophy of Mind", "Biomedical Ethics", "Normative Ethics", "Aesthetics", "Philosophy of Religion"]


def lenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LENSES, "lens_id string, algorithm string, ordinal int, name string")


def keep_longest(rows: DataFrame, key: str, text: str, ordinal: str) -> DataFrame:
    """One row per key: the longest text, the first on ties. Ranked before any cut of the text."""
    w = Window.partitionBy(key).orderBy(F.desc("_chars"), ordinal)
    ranked = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_chars", F.length(F.coalesce(text, F.lit(""))))
    return ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_chars")  # the text itself is only shuffled if it is used


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return keep_longest(table(spark, sf, "paper_metadata"), "paper_id", "description", "row_no")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(paper, lens_id, label SHORT), one row per paper and lens, from one scan."""
    p = papers(spark, sf).select("paper_id", "export_batch", "subject", "pub_type", "pub_date")
    first = F.split(F.coalesce("subject", F.lit("")), "; ")[0]
    subject = F.lit(-1)
    for i, s in enumerate(SUBJECTS):
        subject = F.when(first == s, i).otherwise(subject)
    each = F.array(
        F.struct(F.lit("batch").alias("lens_id"), (F.coalesce("export_batch", F.lit(0)) - 2).cast("short").alias("label")),
        F.struct(F.lit("subject").alias("lens_id"), subject.cast("short").alias("label")),
        F.struct(F.lit("type").alias("lens_id"), type_code(F.col("pub_type")).alias("label")),
        F.struct(F.lit("period").alias("lens_id"), period_code(F.col("pub_date")).alias("label")),
    )
    return p.select(F.col("paper_id").alias("paper"), F.inline(each)).withColumn("label", F.greatest("label", F.lit(-1)).cast("short"))


PERIOD_SQL = """CASE WHEN lower(coalesce(pub_date, '')) LIKE '%manuscript%' OR lower(coalesce(pub_date, '')) LIKE '%forthcoming%' THEN 5
 WHEN yr IS NULL THEN -1 WHEN yr < 1990 THEN 0 WHEN yr < 2000 THEN 1 WHEN yr < 2010 THEN 2 WHEN yr < 2020 THEN 3 ELSE 4 END"""
TYPE_SQL = """CASE WHEN lower(coalesce(pub_type, '')) LIKE '%review%' THEN 2 WHEN lower(coalesce(pub_type, '')) LIKE '%book%' OR lower(coalesce(pub_type, '')) LIKE '%книга%' THEN 1
 WHEN lower(coalesce(pub_type, '')) LIKE '%article%' OR lower(coalesce(pub_type, '')) LIKE '%articolo%' THEN 0 ELSE -1 END"""
YEAR_SQL = "CAST(nullif(regexp_extract(coalesce({0}, ''), '(?:^|[^0-9])(1[5-9][0-9][0-9]|20[0-9][0-9])(?:[^0-9]|$)', 1), '') AS INT)"
PAPERS_CTE = f"""papers AS (SELECT *, {YEAR_SQL.format('pub_date')} AS yr FROM (
 SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY length(coalesce(description, '')) DESC, row_no) AS rn
 FROM paper_metadata WHERE paper_id IS NOT NULL AND paper_id <> '') WHERE rn = 1)"""
_SUBJECT_SQL = "CASE split_part(coalesce(subject, ''), '; ', 1) " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SUBJECTS)) + " ELSE -1 END"
LABELS_CTE = f"""{PAPERS_CTE}, lenses(lens_id, algorithm, ordinal) AS (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c, _ in LENSES)}),
labels AS (SELECT paper, lens_id, CAST(greatest(label, -1) AS SMALLINT) AS label FROM (
 SELECT paper_id AS paper, 'batch' AS lens_id, coalesce(export_batch, 0) - 2 AS label FROM papers
 UNION ALL SELECT paper_id, 'subject', {_SUBJECT_SQL} FROM papers
 UNION ALL SELECT paper_id, 'type', {TYPE_SQL} FROM papers
 UNION ALL SELECT paper_id, 'period', {PERIOD_SQL} FROM papers)),
el AS (SELECT l.*, s.ordinal FROM labels l JOIN lenses s USING (lens_id) WHERE s.algorithm <> 'metadata' OR l.label >= 0)"""
