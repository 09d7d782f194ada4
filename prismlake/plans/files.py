"""Round trips through the file forms, fingerprints and shards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers as R
from ..sources import sinks as K
from ..tables import table


def _path(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def roundtrip_csv(spark, sf):
    p = _path(spark)
    K.csv_table(table(spark, sf, "subject_areas"), p)
    return R.csv(spark, p, "area_code string, area_name string, scope_note string")


def roundtrip_json(spark, sf):
    p = _path(spark)
    K.json_rows(table(spark, sf, "nation"), p)
    return spark.read.json(p, schema="n_nationkey int, n_name string, n_regionkey int")


def roundtrip_lines(spark, sf):
    """A text file of names in order, with blanks lost and the ordinal kept."""
    p = _path(spark)
    n = table(spark, sf, "nation").orderBy("n_nationkey")
    n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat(F.lit(" "), s["n_name"], F.lit("\n\n"))), "").alias("value")).coalesce(1).write.text(p)
    return R.text_lines(spark, p)


def roundtrip_positional(spark, sf):
    """A JSON array of positional rows."""
    p = _path(spark)
    r = table(spark, sf, "region").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: F.array(s["r_regionkey"].cast("string"), s["r_name"]))).alias("value"))
    r.coalesce(1).write.text(p)
    return R.json_positional(spark, p, ["regionkey", "name"])


def roundtrip_labels(spark, sf):
    p = _path(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_idx"), "label")
    K.labels(e, p, e.count())
    return spark.read.parquet(p).select("paper_idx", F.col("label").cast("int").alias("label"))


def roundtrip_shards(spark, sf):
    """One shard of 200 papers, read back alone."""
    p = _path(spark)
    s = table(spark, sf, "search_rows").groupBy("paper_idx").agg(F.max("title").alias("title"))
    K.shards(s, p)
    return K.shard(spark, p, 2).select("paper_idx", "title", F.col("chunk").cast("int").alias("chunk"))


def neighbour_bytes(spark, sf):
    """Three made-up neighbours of every vector, packed in shards of 200 and read back."""
    p = _path(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_idx"), F.array(*[(F.col("vec_id") * 7 + i * 70001) for i in range(3)]).alias("n"))
    K.neighbour_shards(e, p, 3)
    return spark.read.parquet(p).select("chunk", "first", F.hex("packed").alias("packed"))


def uint24_bytes(spark, sf):
    """Order keys packed into three bytes each."""
    o = table(spark, sf, "orders").select("o_orderkey", K.uint24(F.array(F.col("o_orderkey"), F.col("o_custkey"))).alias("b"))
    return o.select("o_orderkey", F.hex("b").alias("packed"))


def compact_json(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", K.as_json("r_regionkey", "r_name").alias("document"))


def corpus_fingerprint(spark, sf):
    s = table(spark, sf, "detail_rows").groupBy("paper_idx").agg(F.max("abstract").alias("abstract"))
    return K.fingerprint(s, "paper_idx", "abstract")


def row_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def file_manifest(spark, sf):
    p = _path(spark)
    table(spark, sf, "region").coalesce(1).write.json(p)
    return K.manifest(spark, p).where("name LIKE 'part-%'").select("bytes", "sha256")


def key_lookup(spark, sf):
    return R.lookup(table(spark, sf, "nation"), {"n_name": "FRANCE"}) if table(spark, sf, "nation").where("n_name = 'FRANCE'").head(1) else R.lookup(table(spark, sf, "nation"), {"n_nationkey": 6})


QUERIES = {f.__name__: f for f in (roundtrip_csv, roundtrip_json, roundtrip_lines, roundtrip_positional, roundtrip_labels, roundtrip_shards, neighbour_bytes, uint24_bytes, compact_json, corpus_fingerprint, row_digests, file_manifest, key_lookup)}
SQL = {
    "roundtrip_csv": "SELECT * FROM subject_areas",
    "roundtrip_json": "SELECT * FROM nation",
    "roundtrip_lines": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name AS line FROM nation",
    "roundtrip_positional": "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS ordinal, CAST(r_regionkey AS VARCHAR) AS regionkey, r_name AS name FROM region",
    "roundtrip_labels": "SELECT vec_id AS paper_idx, label FROM embeddings",
    "roundtrip_shards": "SELECT paper_idx, max(title) AS title, 2 AS chunk FROM search_rows WHERE paper_idx // 200 = 2 GROUP BY 1",
    "neighbour_bytes": """WITH n AS (SELECT vec_id, i, vec_id * 7 + i * 70001 AS x FROM embeddings CROSS JOIN range(3) t(i))
 SELECT vec_id // 200 AS chunk, vec_id // 200 * 200 AS first, string_agg(lpad(to_hex(x & 255), 2, '0') || lpad(to_hex((x >> 8) & 255), 2, '0') || lpad(to_hex((x >> 16) & 255), 2, '0'), '' ORDER BY vec_id, i) AS packed FROM n GROUP BY 1, 2""",
    "uint24_bytes": "SELECT o_orderkey, " + " || ".join(f"lpad(to_hex(({c} >> {s}) & 255), 2, '0')" for c in ("o_orderkey", "o_custkey") for s in (0, 8, 16)) + " AS packed FROM orders",
    "compact_json": "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS document FROM region",
    "corpus_fingerprint": """WITH r AS (SELECT paper_idx AS k, sha256(CAST(paper_idx AS VARCHAR) || '|' || coalesce(max(abstract), '')) AS d FROM detail_rows GROUP BY 1),
 c AS (SELECT k // 10000 AS k, count(*) AS n, sha256(string_agg(d, '' ORDER BY r.k)) AS d FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY k)) AS sha256 FROM c""",
    "row_digests": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "key_lookup": "SELECT * FROM nation WHERE CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_name = 'FRANCE') THEN n_name = 'FRANCE' ELSE n_nationkey = 6 END",
}
