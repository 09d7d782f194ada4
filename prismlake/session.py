"""Session settings and the two ways in which a plan may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "prismlake", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's settings hold."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    return (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests);
    on a cluster that would be one machine's own, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismlake-")
        delete_on_exit(spark, found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the session's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives lost executors. Spark removes its
    files when nothing refers to it any more, and the rest when the JVM ends."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        delete_on_exit(df.sparkSession, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage with a compressed table in the shared folder, for large rows that are read several times: the table
    and its folder. It is deleted when the JVM ends, or by drop()."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    delete_on_exit(df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
