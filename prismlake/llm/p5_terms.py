"""Problem 5: how often every term occurs, and in how many records, kept up to date by signed changes.

Counts are never rebuilt. `CountStore.apply` takes the new versions of the records that were delivered, compares their
digests with the kept ones and so finds what was added, changed or deleted; only then are texts looked at: the new text
of such a record counts +1, its former text -1 (`signed_changes`). `term_deltas` turns the changes into changes per term,
summed on the map side before any shuffle, so a term in every record costs one row per task. The deltas are merged into
the kept counts, which lie in hash partitions (buckets) of the term; buckets without a change are neither read nor
written. The work grows with the change, not with the collection.

A store is a folder; every apply writes a new version and then a manifest that says in which version each bucket was
last written, so a job lost on the way leaves the last version in place and a new process goes on from it.

p5_found loads the deliveries before the last snapshot and then applies those of the last one; its rows are the merged
counts. Its own store lies in the shared folder and is deleted when the session's JVM ends, as the result reads it.

Defined results: a null text is an empty text and has no terms; repeated rows of a key count once (the largest text);
an empty table gives no terms; rows with a null key are left out; no text is cut; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from ..tables import table

MIN_RECORDS = 3
MAX_SHARE = 0.20
BUCKETS = 64


def terms_of(text: Column) -> Column:
    """All terms of a text, in order: maximal runs of letters of any script, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def records(search: DataFrame, detail: DataFrame) -> DataFrame:
    """One row per paper of search: (key, text)."""
    both = search.select(F.col("paper_idx").alias("key"), "title", F.lit(None).cast("string").alias("abstract"), F.lit(1).alias("here")).unionAll(
        detail.select(F.col("paper_idx").alias("key"), F.lit(None).cast("string").alias("title"), "abstract", F.lit(0).alias("here"))
    )
    return (
        both.where(F.col("key").isNotNull())
        .groupBy("key").agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"), F.max("here").alias("here"))
        .where("here = 1")
        .select("key", F.concat_ws("\n", "title", "abstract").alias("text"))
    )


def digest(text: Column) -> Column:
    """128 bits of a text: two 64-bit hashes of it."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text, F.lit(3)).alias("b"))


def signed_changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(sign, text): -1 for former, +1 for new versions. old, new: (key, text) of changed records only."""
    plus = new.where("text IS NOT NULL").select(F.lit(1).cast("long").alias("sign"), "text")
    return plus if old is None else plus.unionAll(old.where("text IS NOT NULL").select(F.lit(-1).cast("long").alias("sign"), "text"))


def term_deltas(changes: DataFrame) -> DataFrame:
    """(term, uses, records): the change each term's counts undergo."""
    words = changes.select("sign", F.sort_array(terms_of(F.col("text"))).alias("w"))
    marked = F.transform("w", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (x != F.get(F.col("w"), i - 1)), 1).otherwise(0).alias("first")))
    return (
        words.select("sign", F.inline(marked))
        .groupBy("term")
        .agg(F.sum("sign").alias("uses"), F.sum(F.col("sign") * F.col("first")).alias("records"))
    )


def merge_counts(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The new counts; terms no record holds any more leave the table."""
    both = deltas if counts is None else counts.select("term", "uses", "records").unionByName(deltas)
    merged = both if counts is None else both.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))
    return merged.where("records > 0")


def mark(counts: DataFrame, total: Column | int, min_records: int = MIN_RECORDS, max_share: float = MAX_SHARE) -> DataFrame:
    """counts with mark `rare`, `common` or null (useful)."""
    n = total if isinstance(total, Column) else F.lit(total)
    return counts.withColumn("mark", F.when(F.col("records") < min_records, "rare").when(F.col("records") > n * F.lit(max_share), "common"))


class CountStore:
    """Kept counts and digests in a folder:

    terms/v{n}/bucket={b}    (term, uses, records) of the buckets version n changed
    digests/v{n}/bucket={b}  (key, a, b) of the buckets version n changed
    manifest/v{n}            (kind, bucket, version): where each bucket was last written; its _SUCCESS makes n current

    The manifest has 2 x buckets rows at most; it alone is read by the driver.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(x[1:]) for x in self._names("manifest") if self._fs.exists(self._path(f"{self.path}/manifest/{x}/_SUCCESS"))]
        self.version = max(found, default=0)
        self.places: dict[tuple[str, int], int] = {}
        self.buckets = buckets
        if self.version:
            for r in spark.read.parquet(f"{self.path}/manifest/v{self.version}").collect():
                if r["kind"] == "buckets":
                    self.buckets = r["bucket"]  # those the store was made with
                else:
                    self.places[r["kind"], r["bucket"]] = r["version"]

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read(self, kind: str, schema: str, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/v{v}/bucket={b}" for (k, b), v in sorted(self.places.items()) if k == kind and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, kind: str, rows: DataFrame, key: str, folder: str) -> set[int]:
        """rows into folder by bucket; the buckets that have any."""
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        bucketed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{folder}")
        return {int(x.split("=")[1]) for x in self._names(folder) if x.startswith("bucket=")}

    def counts(self) -> DataFrame:
        return self._read("terms", "term string, uses long, records long")

    def digests(self, only: set[int] | None = None) -> DataFrame:
        return self._read("digests", "key long, a long, b long", only)

    def apply(self, new: DataFrame, former: DataFrame | None = None) -> DataFrame:
        """Take in the delivered records. new: (key, text), one row per key, a null text deletes the record; former:
        (key, text), the versions last taken in, of these keys at least; not needed if none of them was there before.
        Returns the counts."""
        n = self.version + 1
        new = cut(new.where("key IS NOT NULL").select("key", "text", digest(F.col("text")).alias("d")))
        touched = {r[0] for r in new.select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")).distinct().collect()} if self.version else set()
        kept = self.digests(touched).select("key", F.struct("a", "b").alias("o"))
        state = new.select("key", "d", F.col("text").isNotNull().alias("lives")).join(kept, "key", "left") if touched else new.select("key", "d", F.col("text").isNotNull().alias("lives"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("o"))
        changed = state.where("(lives AND (o IS NULL OR o <> d)) OR (NOT lives AND o IS NOT NULL)")
        if touched:
            changed = cut(changed)
            gone = changed.where("o IS NOT NULL").select("key")
            if former is None:
                if not gone.isEmpty():
                    raise ValueError("records change, so their former versions are needed")
                old = None
            else:
                old = former.join(gone, "key", "left_semi").select("key", "text")
            text = new.join(changed.select("key"), "key", "left_semi").select("key", "text")
        else:
            old, text = None, new.select("key", "text")
        places = dict(self.places)
        delta = term_deltas(signed_changes(old, text))
        if self.version:
            hit = self._write("terms", delta, "term", f"deltas/v{n}")
            both = self.spark.read.schema("term string, uses long, records long").parquet(*[f"{self.path}/deltas/v{n}/bucket={b}" for b in sorted(hit)]) if hit else delta.limit(0)
            merged = merge_counts(self._read("terms", "term string, uses long, records long", hit), both)
        else:
            hit, merged = set(), merge_counts(None, delta)
        left = self._write("terms", merged, "term", f"terms/v{n}")
        places = {k: v for k, v in places.items() if not (k[0] == "terms" and k[1] in hit)} | {("terms", b): n for b in left}
        if touched:
            rest = self.digests(touched).join(changed.select("key"), "key", "left_anti").unionByName(changed.where("lives").select("key", "d.a", "d.b"))
            hit = {r[0] for r in changed.select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")).distinct().collect()}
            rest = rest.where(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).isin(sorted(hit)))
        else:
            hit, rest = set(), new.where("text IS NOT NULL").select("key", "d.a", "d.b")
        left = self._write("digests", rest, "key", f"digests/v{n}")
        places = {k: v for k, v in places.items() if not (k[0] == "digests" and k[1] in hit)} | {("digests", b): n for b in left}
        rows = [(k, b, v) for (k, b), v in sorted(places.items())] + [("buckets", self.buckets, 0)]
        self.spark.createDataFrame(rows, "kind string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{n}")
        self.version, self.places = n, places
        self._fs.delete(self._path(f"{self.path}/deltas/v{n}"), True)
        return self.counts()

    def vacuum(self) -> None:
        """Delete versions of buckets and manifests that the current one doesn't need; readers of older ones lose them."""
        live = {f"{k}/v{v}/bucket={b}" for (k, b), v in self.places.items()}
        for kind in ("terms", "digests"):
            for v in self._names(kind):
                inside = [f"{kind}/{v}/{x}" for x in self._names(f"{kind}/{v}") if x.startswith("bucket=")]
                for x in inside if set(inside) & live else [f"{kind}/{v}"]:
                    if x not in live:
                        self._fs.delete(self._path(f"{self.path}/{x}"), True)
        for v in self._names("manifest"):
            if v != f"v{self.version}":
                self._fs.delete(self._path(f"{self.path}/manifest/{v}"), True)

    def delete_on_exit(self) -> None:
        self._fs.deleteOnExit(self._path(self.path))


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "search_rows").select("paper_idx", "title", F.coalesce("snapshot_no", F.lit(0)).alias("snapshot_no")),
        table(spark, sf_dir, "detail_rows").select("paper_idx", "abstract"),
    )


def _store(spark: SparkSession, sf_dir: str, steps: int, buckets: int) -> CountStore:
    """A store that took in the tables: what came before the last `steps` snapshots at once, then snapshot by snapshot."""
    import uuid

    s, d = _sources(spark, sf_dir)
    store = CountStore(spark, f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}", buckets)
    store.delete_on_exit()
    snapshots = sorted(r[0] for r in s.select("snapshot_no").distinct().collect())  # one row per delivery
    for i, k in enumerate(snapshots[-steps:] if steps < len(snapshots) else snapshots[1:]):
        if i == 0:
            store.apply(records(s.where(F.col("snapshot_no") < k), d))
        keys = s.where(F.col("snapshot_no") == k).select("paper_idx").distinct()
        of = lambda rows: rows.join(keys, "paper_idx", "left_semi")
        detail = cut(of(d))
        store.apply(records(of(s.where(F.col("snapshot_no") <= k)), detail), records(of(s.where(F.col("snapshot_no") < k)), detail))
    if len(snapshots) < 2:
        store.apply(records(s, d))
    return store


def _marked(store: CountStore) -> DataFrame:
    total = store.digests().select(F.count("*").alias("n_records"))
    return mark(store.counts().crossJoin(F.broadcast(total)), F.col("n_records")).select("term", "uses", "records", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(_store(spark, sf_dir, 1, BUCKETS))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_counts(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, reached snapshot by snapshot."""
    return _store(spark, sf_dir, 1 << 30, 8).counts()


_COUNTS = r"""
WITH r AS (SELECT s.paper_idx, s.title, d.abstract FROM (SELECT paper_idx, max(title) AS title FROM search_rows WHERE paper_idx IS NOT NULL GROUP BY 1) s
  LEFT JOIN (SELECT paper_idx, max(abstract) AS abstract FROM detail_rows GROUP BY 1) d USING (paper_idx)),
w AS (SELECT paper_idx, unnest(regexp_extract_all(lower(concat_ws(chr(10), title, abstract)), '\p{L}+')) AS term FROM r),
c AS (SELECT term, count(*) AS uses, count(DISTINCT paper_idx) AS records FROM w GROUP BY 1),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts, "p5_incremental": p5_incremental}
SQL = {
    "p5_found": _COUNTS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _COUNTS + "SELECT term, uses, records, mark FROM m",
    "p5_incremental": _COUNTS + "SELECT term, uses, records FROM m",
}
