"""Scans and sinks (survey items A1–A4, A7, A8, A11).

Readers always pass an explicit schema or read Parquet (which carries one),
and project early so column pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import prompt_id_from_id

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

RESPONSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("prompt_id", T.StringType()),
    T.StructField("sample_num", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("topic_label", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("reference_answer", T.StringType()),
    T.StructField("model_answer", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("generated_tokens", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("correctness", T.StringType()),
    T.StructField("adversarial", T.BooleanType()),
    T.StructField("correctness_score", T.IntegerType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan a driver table, projecting ``columns`` so pruning reaches the reader.

    Any path that Spark's readers open will do; the number of scan tasks
    follows from the files and ``spark.sql.files.maxPartitionBytes``.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, required: list[str] | None) -> DataFrame:
    """A1: raise when required columns are missing (checked on the schema, no job)."""
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def with_response_defaults(df: DataFrame) -> DataFrame:
    """A1: derive ``prompt_id`` (id up to its last underscore) and ``answer_len`` where absent or null."""
    derived = prompt_id_from_id("id")
    df = df.withColumn("prompt_id", F.coalesce("prompt_id", derived) if "prompt_id" in df.columns else derived)
    if "answer_len" not in df.columns:
        df = df.withColumn("answer_len", F.length(F.coalesce(F.col("model_answer").cast("string"), F.lit(""))))
    return df


def load_responses(spark: SparkSession, path: str, required_cols: list[str] | None = None,
                   schema: T.StructType = RESPONSE_SCHEMA) -> DataFrame:
    """A1/A2/A3: JSONL responses (a file or a folder of ``*.jsonl``) with a fixed schema.

    One read covers every dataset file; the ``dataset`` column is the key,
    so there is no dictionary of per-dataset frames.
    """
    df = spark.read.schema(schema).json(path)
    return with_response_defaults(require_columns(df, required_cols))


def load_dataframe(spark: SparkSession, path: str, schema: T.StructType | None = None, **csv_options) -> DataFrame:
    """A4: dispatch on the file suffix (parquet / csv / jsonl); other suffixes are errors.

    JSON and CSV without a ``schema`` are read twice, the first time to infer it (CSV columns are then strings).
    """
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if low.endswith(".csv"):
        return reader.options(**({"header": "true"} | csv_options)).csv(path)
    if low.endswith(".jsonl") or low.endswith(".json"):
        return reader.json(path)
    raise ValueError(f"Unsupported file type: {path}")


def load_vector_map(spark: SparkSession, path: str) -> DataFrame:
    """A10: (id, vec) of JSON files that each hold one object of id → vector, or such an object under ``data``.

    A file is one JSON value, so one task reads it; many files spread.  A vector that is no list of numbers is an error.
    """
    kind = "map<string,array<double>>"
    fail = {"mode": "FAILFAST"}
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.get_json_object("value", "$.data").startswith("{")
    found = F.when(F.coalesce(wrapped, F.lit(False)), F.from_json("value", f"data {kind}", fail)["data"]).otherwise(F.from_json("value", kind, fail))
    return whole.select(F.explode(found).alias("id", "vec"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name, missing columns filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append sink (JSONL / CSV / Parquet)."""
    w = df.write.mode("append")
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, str]]:
    """(name after the prefix, path) of the folders under ``path``, on any file system; none if ``path`` is missing."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(root) if f.isDirectory()]
    return sorted((n[len(prefix):], p) for n, p in found if n.startswith(prefix))


def committed_versions(spark: SparkSession, root: str, upto: int | None = None) -> list[tuple[int, str]]:
    """Versions under ``root`` whose job has committed (Spark's ``_SUCCESS`` is its last, atomic step), in order."""
    jvm = spark._jvm
    out = []
    for n, path in _folders(spark, root, "v="):
        done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) and (upto is None or int(n) <= upto):
            out.append((int(n), path))
    return out


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """Write a version into a folder of its own; a version being read is never touched, a retry replaces its own."""
    target = f"{root.rstrip('/')}/v={version:09d}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(target)
    return target


def read_current(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame | None:
    """The latest committed version, or None if there is none; any other failure is an error."""
    have = committed_versions(spark, root, upto)
    return spark.read.parquet(have[-1][1]) if have else None


def read_buckets(spark: SparkSession, root: str, upto: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """Rows of the latest committed version of each ``bucket=`` folder (of those in ``only``), or None if there are none."""
    latest: dict[str, str] = {}
    for _, path in committed_versions(spark, root, upto):
        latest.update(_folders(spark, path, "bucket="))
    paths = [p for b, p in sorted(latest.items()) if only is None or int(b) in only]
    return spark.read.parquet(*paths) if paths else None
