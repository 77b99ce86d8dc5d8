"""Readers and writers of text, JSON lines, PDF folders, tables and settings."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill import schemas
from lexmill.functions import text as tx


class MissingInput(FileNotFoundError):
    """An input is absent or empty."""


def resolve(path: str, root: str) -> str:
    """The path itself if it is absolute or has a scheme, else below the root."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _status(spark: SparkSession, path: str):
    fs, p = _file_system(spark, path)
    return fs.getContentSummary(p) if fs.exists(p) else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path names."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes and times of the files below a path, on any file system."""
    fs, p = _file_system(spark, path)
    found, each = [], fs.listFiles(p, True) if fs.exists(p) else None
    while each is not None and each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha1(json.dumps([path, sorted(found)]).encode()).hexdigest()


def require_inputs(spark: SparkSession, paths: list[str], allow_empty: bool = False) -> list[str]:
    """The paths, if all exist and none is empty."""
    for path in paths:
        status = _status(spark, path)
        if status is None or (not allow_empty and status.getLength() == 0):
            raise MissingInput(f"missing or empty input: {path}")
    return paths


def read_lines(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """(file, path, pos, text): the lines of text files; ``file`` is the place of the path in the list, ``pos`` the
    number of the line in its file.

    The scan is split, so files may have any size: lines are numbered in their split, and the splits' counts are
    summed.  Invalid UTF-8 becomes U+FFFD, or is an error if ``strict``.
    """
    require_inputs(spark, paths, allow_empty=True)
    raw = None
    for i, path in enumerate(paths):
        one = spark.read.text(path).select(
            F.lit(i).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"), (F.validate_utf8("value") if strict else F.make_valid_utf8("value")).alias("text"),
        )
        raw = one if raw is None else raw.unionByName(one)
    if raw is None:
        return spark.createDataFrame([], "file int, path string, pos long, text string")
    counts = raw.groupBy("file", "path", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "path", "block").orderBy("seq")) - 1
    return raw.withColumn("inside", inside).join(counts, ["file", "path", "block"]).select("file", "path", (F.col("inside") + F.col("before")).cast("long").alias("pos"), "text")


def scan_lines(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """(path, text): lines without their numbers, from splittable scans of any size."""
    require_inputs(spark, paths, allow_empty=True)
    clean = F.validate_utf8("value") if strict else F.make_valid_utf8("value")
    return spark.read.text(paths).select(F.input_file_name().alias("path"), clean.alias("text"))


def nonblank(lines: DataFrame, column: str = "text") -> DataFrame:
    """Stripped lines, blank ones dropped."""
    return lines.withColumn(column, tx.strip(column)).filter(F.col(column) != "")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones are an error, as are missing required keys."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        checked = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"missing key {name}"))).otherwise(F.col(name))
        df = df.withColumn(name, checked.cast(schema[name].dataType))
    return df


def read_sts(spark: SparkSession, path: str, score_scale: float = 5.0) -> DataFrame:
    """Sentence pairs with normalised sentences and scores divided by the scale."""
    df = read_jsonl(spark, path, schemas.STS_PAIR, ("sentence_a", "sentence_b", "score"))
    return scaled_pairs(df, score_scale)


def scaled_pairs(pairs: DataFrame, score_scale: float = 5.0) -> DataFrame:
    return pairs.withColumns({"sentence_a": tx.normalize("sentence_a"), "sentence_b": tx.normalize("sentence_b"), "score": F.col("score") / score_scale})


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    require_inputs(spark, [path])
    return read_jsonl(spark, path, schemas.TRIPLET, ("anchor", "positive", "negative"))


def read_head(spark: SparkSession, path: str, n: int, schema: T.StructType = schemas.EMBEDDING) -> DataFrame:
    """The first n records; the scan stops early."""
    return spark.read.schema(schema).json(path).limit(n)


def gold_items(questions: DataFrame) -> DataFrame:
    """Gold questions as rows of the item table."""
    return questions.select("sentence_a", "sentence_b", F.lit(0.0).alias("uncertainty"), F.lit("gold").alias("status"), F.col("score").cast("double").alias("gold_label"))


def read_table(spark: SparkSession, location: str, name: str, **options: str) -> DataFrame:
    """A table of a parquet folder or of a JDBC database; filters and columns are pushed down by Spark."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
    return spark.read.parquet(f"{location.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """(path, text): the text of binary documents such as PDF, their pages joined by line breaks.

    ``extract`` gives the pages of a document (a page without text may be None); by default that of the
    optional library pypdf, which must then be installed.
    """

    def pages_of(data: bytes) -> list[str | None]:
        try:
            from pypdf import PdfReader
        except ImportError as error:
            raise RuntimeError("reading PDF needs the library pypdf, or an extract function") from error
        import io

        return [page.extract_text() for page in PdfReader(io.BytesIO(data)).pages]

    pages = extract or pages_of

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": ["\n".join(p or "" for p in pages(bytes(c))) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def latest_values(cache: DataFrame, order: Column) -> DataFrame:
    """(key, value): the last value written for each key."""
    return cache.groupBy("key").agg(F.max_by("value", order).alias("value"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The key/value cache; an absent file is an empty cache.  Later files and lines win."""
    if _status(spark, path) is None:
        return spark.createDataFrame([], schemas.CACHE)
    rows = spark.read.schema(schemas.CACHE).json(path).select("key", "value", "_metadata.file_modification_time", "_metadata.file_name", F.monotonically_increasing_id().alias("line"))
    return latest_values(rows, F.struct("file_modification_time", "file_name", "line"))


def append_cache(entries: DataFrame, path: str) -> None:
    """Adds successes only: null and empty values are failures and never stored."""
    entries.filter(F.length("value") > 0).select("key", "value").write.mode("append").json(path)


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Rows that were written, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"] or 0)


def write_corpus(corpus: DataFrame, path: str, order: tuple[str, ...] = ("pos",), single_file: bool = False) -> int:
    """One line a record, in order; returns the number of lines."""
    ordered = corpus.orderBy(*order).select("text")
    return _counted(ordered.coalesce(1) if single_file else ordered, lambda df: df.write.mode("overwrite").text(path))


def write_jsonl(df: DataFrame, path: str, schema: T.StructType) -> int:
    """The schema's columns in its order, characters unescaped; returns the number of records."""
    return _counted(df.select(*[F.col(f.name).cast(f.dataType) for f in schema]), lambda rows: rows.write.mode("overwrite").json(path))


def append_rows(rows: DataFrame, location: str, name: str, schema: T.StructType, **options: str) -> int:
    """Adds rows to a table of a folder or of a JDBC database; the number of rows.

    The columns are cast to the table's schema, and a column of it that the rows lack is null.
    """
    own = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    if location.startswith("jdbc:"):
        return _counted(own, lambda df: df.write.format("jdbc").options(url=location, dbtable=name, **options).mode("append").save())
    return _counted(own, lambda df: df.write.mode("append").parquet(f"{location.rstrip('/')}/{name}.parquet"))


def write_metrics(metrics: DataFrame, path: str) -> dict[str, float]:
    """Flat JSON of (branch, metric, value) rows, keys metric_branch; a metrics table has some tens of rows."""
    rows = metrics.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a metrics table has at most 10,000 rows")
    flat = {f"{r.metric}_{r.branch}": r.value for r in sorted(rows, key=lambda r: (r.branch, r.metric))}
    write_small(metrics.sparkSession, path, json.dumps(flat, indent=2))
    return flat


def write_config(spark: SparkSession, path: str, settings: dict) -> None:
    """Settings as JSON, which every YAML reader takes too."""
    write_small(spark, path, json.dumps(settings, indent=2, ensure_ascii=False))


def read_config(path: str) -> dict:
    """A file in JSON, whatever its ending, or in YAML if the optional library yaml is installed."""
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json") or content.lstrip().startswith("{"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the library yaml; JSON needs none") from error
    return yaml.safe_load(content) or {}


def jdbc_url(env: dict[str, str] | None = None) -> str:
    """URL of the annotation database from POSTGRES_* settings."""
    e = os.environ if env is None else env
    return f"jdbc:postgresql://{e.get('POSTGRES_HOST', 'localhost')}:{e.get('POSTGRES_PORT', '5432')}/{e.get('POSTGRES_DB', 'postgres')}"


def check_free_space(free_bytes: int, min_free_gb: float, reserve_bytes: int = 0) -> None:
    """Error if less than the wanted room would be left."""
    if free_bytes - reserve_bytes < min_free_gb * 1024**3:
        raise OSError(f"{free_bytes / 1024**3:.2f} GB free, {reserve_bytes / 1024**3:.2f} GB needed, {min_free_gb} GB must stay")


def write_embeddings(encoded: DataFrame, path: str, free_bytes: int | None = None, min_free_gb: float = 5.0) -> int:
    """(text, embedding) rows as JSON lines, after a check of the room on the disk; returns the number of rows.

    Spark writes in parallel and in Arrow batches, so there is no chunk size; an aborted write leaves no
    committed output.
    """
    from lexmill.functions import vector as vx

    size = vx.jsonl_bytes(encoded).first()
    free = free_bytes
    if free is None:
        spark = encoded.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        free = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getStatus().getRemaining()
    check_free_space(free, min_free_gb, size["bytes"] or 0)
    return write_jsonl(encoded, path, schemas.EMBEDDING)
