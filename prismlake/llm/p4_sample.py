"""Problem 4: a sample that stays the same in every rerun and only grows as records arrive.

Every key has one fixed position in [0, 1): the first 52 bits of SHA-256 over salt and key. Every stratum has a fixed
rate, and its threshold is the highest rate it ever had: `raised` merges new rates into the kept table of thresholds by
the greater value, and `Thresholds` keeps that table. A delivery is drawn if its key's position lies below its stratum's
threshold, a key if any of its deliveries is. Positions depend on the key alone and neither a new delivery, early or
late or in another stratum, nor a new rate can turn a drawn delivery into one that isn't, so what was drawn stays drawn.
Nothing depends on how many records there are.

The draw filters deliveries before anything is shuffled; only drawn ones are grouped by key.

Defined results: rows whose key is null or "" are not drawn; a null stratum is the stratum "unknown"; strata without a
rate take the default; a null snapshot is snapshot 0; a rate of 0 or null draws nothing, one of 1 or more everything; an
empty table gives an empty sample; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table

SALT = "prismlake-sample-1"
#: Share of each stratum that is drawn.
RATES = {"undated": 0.10, "before 1980": 0.10, "1980-1999": 0.06, "2000-2009": 0.04, "2010-2019": 0.03, "2020-": 0.03}
DEFAULT_RATE = 0.05


def position(key: Column, salt: str = SALT) -> Column:
    """The key's place in [0, 1): exact in DOUBLE, equal in any engine that has SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt + ":"), key), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def period(pub_date: Column) -> Column:
    """Stratum of a free-text date: the first stand-alone year 1500-2099 in bands."""
    year = F.regexp_extract(F.coalesce(pub_date, F.lit("")), r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)", 1)
    y = F.when(year != "", year.cast("int"))
    return (
        F.when(y.isNull(), "undated").when(y < 1980, "before 1980").when(y < 2000, "1980-1999")
        .when(y < 2010, "2000-2009").when(y < 2020, "2010-2019").otherwise("2020-")
    )


def deliveries(rows: DataFrame, key: str, stratum: Column, snapshot: str) -> DataFrame:
    """(key, stratum, snapshot) of the rows that have a key."""
    found = rows.select(F.col(key).alias("key"), F.coalesce(stratum, F.lit("unknown")).alias("stratum"), F.coalesce(F.col(snapshot).cast("long"), F.lit(0)).alias("snapshot"))
    return found.where("key IS NOT NULL AND key <> ''")


def rates_table(spark: SparkSession, rates: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rates.items()], "stratum string, rate double")


def raised(kept: DataFrame | None, rates: DataFrame) -> DataFrame:
    """(stratum, threshold): per stratum the greater of the kept threshold and the new rate. rates: (stratum, rate)."""
    new = rates.where("stratum IS NOT NULL").select("stratum", F.coalesce("rate", F.lit(0.0)).alias("threshold"))
    both = new if kept is None else kept.select("stratum", "threshold").unionByName(new)
    return both.groupBy("stratum").agg(F.max("threshold").alias("threshold"))


class Thresholds:
    """The table of thresholds in a folder, one version beside the last; `raise_to` writes the next and returns it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The last version that was written whole; 0 if there is none."""
        jvm, fs, at = self._files()
        if not fs.exists(at):
            return 0
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName()[1:]) for p in done), default=0)

    def read(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.path}/v{n}") if n else None

    def raise_to(self, rates: DataFrame) -> DataFrame:
        raised(self.read(), rates).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1}")
        return self.read()


def draw(found: DataFrame, thresholds: DataFrame, default: float = DEFAULT_RATE, salt: str = SALT) -> DataFrame:
    """(key, stratum, drawn_snapshot): each drawn key with the first delivery that draws it (ties: the smallest stratum).
    found: (key, stratum, snapshot); thresholds: (stratum, threshold)."""
    limit = F.coalesce("threshold", F.lit(float(default)))
    drawn = found.join(thresholds, "stratum", "left").where(position(F.col("key"), salt) < limit)
    return drawn.groupBy("key").agg(F.min(F.struct("snapshot", "stratum")).alias("m")).select("key", "m.stratum", F.col("m.snapshot").alias("drawn_snapshot"))


def report(found: DataFrame, drawn: DataFrame, thresholds: DataFrame, default: float = DEFAULT_RATE) -> DataFrame:
    """(stratum, snapshot, threshold, population, drawn): keys of each stratum up to each snapshot and those of them in
    the sample. A key counts in the stratum of its first delivery, a drawn one in that which draws it."""
    first = found.groupBy("key").agg(F.min(F.struct("snapshot", "stratum")).alias("m")).select("m.stratum", "m.snapshot", F.lit(1).alias("p"), F.lit(0).alias("d"))
    both = first.unionAll(drawn.select("stratum", F.col("drawn_snapshot").alias("snapshot"), F.lit(0).alias("p"), F.lit(1).alias("d")))
    upto = Window.partitionBy("stratum").orderBy("snapshot")  # over (strata x snapshots) rows
    return (
        both.groupBy("stratum", "snapshot").agg(F.sum("p").alias("p"), F.sum("d").alias("d"))
        .join(thresholds, "stratum", "left")
        .select("stratum", "snapshot", F.coalesce("threshold", F.lit(float(default))).alias("threshold"), F.sum("p").over(upto).alias("population"), F.sum("d").over(upto).alias("drawn"))
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "search_rows").select("paper_id", "pub_date", "snapshot_no")
    return deliveries(rows, "paper_id", period(F.col("pub_date")), "snapshot_no"), raised(None, rates_table(spark, RATES))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(*_inputs(spark, sf_dir)).withColumnRenamed("key", "paper_id")


def p4_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, population and sample of each stratum after each snapshot."""
    found, thresholds = _inputs(spark, sf_dir)
    return report(found, draw(found, thresholds), thresholds)


_FOUND = """
found AS (SELECT paper_id AS key, coalesce(snapshot_no::BIGINT, 0) AS snapshot,
    CASE WHEN y IS NULL THEN 'undated' WHEN y < 1980 THEN 'before 1980' WHEN y < 2000 THEN '1980-1999'
         WHEN y < 2010 THEN '2000-2009' WHEN y < 2020 THEN '2010-2019' ELSE '2020-' END AS stratum
  FROM (SELECT *, CAST(nullif(regexp_extract(coalesce(pub_date, ''), '(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)', 1), '') AS INT) AS y FROM search_rows)
  WHERE paper_id IS NOT NULL AND paper_id <> ''),
t(stratum, threshold) AS (VALUES ('undated', 0.10::DOUBLE), ('before 1980', 0.10::DOUBLE), ('1980-1999', 0.06::DOUBLE), ('2000-2009', 0.04::DOUBLE), ('2010-2019', 0.03::DOUBLE), ('2020-', 0.03::DOUBLE)),
drawn AS (SELECT key, (m).stratum AS stratum, (m).snapshot AS drawn_snapshot FROM (
  SELECT key, min({'snapshot': snapshot, 'stratum': stratum}) AS m FROM found JOIN t USING (stratum)
  WHERE CAST('0x' || substr(sha256('prismlake-sample-1:' || key), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < threshold GROUP BY key))
"""

QUERIES = {"p4_sample": p4_sample, "p4_strata": p4_strata}
SQL = {
    "p4_sample": f"WITH {_FOUND} SELECT key AS paper_id, stratum, drawn_snapshot FROM drawn",
    "p4_strata": f"""WITH {_FOUND},
ev AS (SELECT (m).stratum AS stratum, (m).snapshot AS snapshot, 1 AS p, 0 AS d FROM (SELECT key, min({{'snapshot': snapshot, 'stratum': stratum}}) AS m FROM found GROUP BY key)
  UNION ALL SELECT stratum, drawn_snapshot, 0, 1 FROM drawn),
n AS (SELECT stratum, snapshot, sum(p) AS p, sum(d) AS d FROM ev GROUP BY ALL)
SELECT stratum, snapshot, threshold, CAST(sum(p) OVER (PARTITION BY stratum ORDER BY snapshot) AS BIGINT) AS population,
 CAST(sum(d) OVER (PARTITION BY stratum ORDER BY snapshot) AS BIGINT) AS drawn FROM n JOIN t USING (stratum)""",
}
