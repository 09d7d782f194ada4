"""Readers of the file forms the corpus comes in; every reader gives a DataFrame with an explicit key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import require_columns


def parquet(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, required) if required else df


def _in_order(files: DataFrame, rows: str) -> DataFrame:
    """(ordinal, item): the members of the array `rows` of each file, files in the order of their path and numbered
    through. Only one row per file is ordered in one task; each file is one task, as its order is part of the data."""
    each = files.select("path", F.posexplode(rows).alias("at", "item"))
    before = files.select("path", (F.sum(F.size(rows)).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.size(rows)).alias("before"))
    return each.join(before, "path").select((F.col("before") + F.col("at")).cast("long").alias("ordinal"), "item")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of text files without blank lines; the ordinal is the place in the file, files in order of path."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    kept = files.select("path", F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("rows"))
    return _in_order(kept, "rows").select("ordinal", F.col("item").alias("line"))


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header row, without inference; a byte-order mark is no part of the first name."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=True, escape='"')


def lookup(df: DataFrame, expected: dict) -> DataFrame:
    """The rows that equal all expected values; raises if there is none or more than one."""
    for c, v in expected.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    n = len(df.take(2))
    if n != 1:
        raise ValueError(f"{'no row' if n == 0 else 'several rows'} for {expected}")
    return df


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def json_positional(spark: SparkSession, path: str, names: list[str], expected: int | None = None) -> DataFrame:
    """JSON arrays of positional rows, one per file (shard): (ordinal, the named columns), shards in order of path and
    numbered through. Raises if there are not `expected` rows in all."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = files.select("path", F.from_json("value", "array<array<string>>").alias("rows"))
    if expected is not None:
        n = parsed.agg(F.sum(F.size("rows"))).first()[0] or 0
        if n != expected:
            raise ValueError(f"{n} rows, not {expected}")
    return _in_order(parsed, "rows").select("ordinal", *[F.get("item", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _decoded(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                yield decode(p, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def int16_labels(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(paper_idx, label) of a little-endian int16 file; raises if it doesn't hold `count` labels."""

    def decode(p, content):
        import numpy as np

        v = np.frombuffer(content, "<i2")
        if count is not None and len(v) != count:
            raise ValueError(f"{p} has {len(v)} labels, not {count}")
        return pd.DataFrame({"paper_idx": np.arange(len(v)), "label": v})

    return _decoded(spark, path, decode, "paper_idx long, label short")


def float32_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(paper_idx, x, y, z); raises if bytes are left over or a value isn't finite."""

    def decode(p, content):
        import numpy as np

        if len(content) % 12:
            raise ValueError(f"{p} doesn't hold whole points")
        v = np.frombuffer(content, "<f4").reshape(-1, 3)
        if not np.isfinite(v).all():
            raise ValueError(f"{p} holds values that aren't finite")
        return pd.DataFrame({"paper_idx": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    return _decoded(spark, path, decode, "paper_idx long, x float, y float, z float")


def uint24_neighbours(spark: SparkSession, path: str, k: int, chunk: int = 200) -> DataFrame:
    """(paper_idx, neighbours) of shards named by number, `k` little-endian 24-bit numbers a row."""

    def decode(p, content):
        import re

        import numpy as np

        b = np.frombuffer(content, np.uint8).reshape(-1, k, 3).astype(np.int32)
        shard = int(re.search(r"(\d+)\.\w+$", p)[1])
        return pd.DataFrame({"paper_idx": shard * chunk + np.arange(len(b)), "neighbours": list(b[:, :, 0] | b[:, :, 1] << 8 | b[:, :, 2] << 16)})

    return _decoded(spark, path, decode, "paper_idx long, neighbours array<int>")


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, v) of a two-dimensional .npy file of numbers."""

    def decode(p, content):
        import io

        import numpy as np

        v = np.load(io.BytesIO(content), allow_pickle=False)
        if v.ndim != 2:
            raise ValueError(f"{p} has {v.ndim} dimensions")
        return pd.DataFrame({"ordinal": np.arange(len(v)), "v": list(v.astype(np.float32))})

    return _decoded(spark, path, decode, "ordinal long, v array<float>")


def xlsx(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(row_no, the required columns as text) of a workbook's first sheet; raises if a column is missing."""

    def decode(p, content):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        z = zipfile.ZipFile(io.BytesIO(content))
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]

        def column(ref: str) -> int:
            n = 0
            for ch in re.match("[A-Z]+", ref)[0]:
                n = n * 26 + ord(ch) - 64
            return n - 1

        rows = []
        for row in ElementTree.parse(z.open(sheet)).iter(f"{ns}row"):
            cells = {}
            for c in row.iter(f"{ns}c"):
                v, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else None if v is None else v.text
                cells[column(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append(cells)
        head = {v: k for k, v in (rows[0] if rows else {}).items()}
        if gone := [c for c in required if c not in head]:
            raise ValueError(f"{p} lacks the columns {gone}")
        body = rows[1:]
        return pd.DataFrame({"row_no": range(1, len(body) + 1)} | {c: [r.get(head[c]) for r in body] for c in required})

    return _decoded(spark, path, decode, "row_no long, " + ", ".join(f"`{c}` string" for c in required))


def candidates_table(df: DataFrame, source: str) -> DataFrame:
    """Hits of a bibliographic service, fetched elsewhere: at most five per record, in the service's order."""
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("position")
    return df.withColumn("source", F.lit(source)).withColumn("_n", F.row_number().over(w)).where("_n <= 5").drop("_n")


def embedded(texts: DataFrame, text: str, model, width: int, batch: int = 32, name: str = "embedding") -> DataFrame:
    """texts with a vector each from `model`, a function that loads and returns list[str] -> array; once per worker."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + f", `{name}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = model()
        for pdf in batches:
            out = [np.asarray(encode([t or "" for t in pdf[text].iloc[i : i + batch]]), dtype=np.float32) for i in range(0, len(pdf), batch)]
            v = np.concatenate(out) if out else np.empty((0, width), np.float32)
            if v.shape[1] != width:
                raise ValueError(f"the model gives {v.shape[1]} numbers, not {width}")
            yield pdf.assign(**{name: list(v)})

    return texts.mapInPandas(run, schema)
