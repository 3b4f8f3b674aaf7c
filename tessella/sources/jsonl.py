"""JSON-lines sources and sinks: files or folders of ``.jsonl``, ``.json`` and either with ``.gz``, in any store Spark reads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
OLD = ".old"
#: Blocks of files whose counts are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, value) of every line, blank ones too: ``line`` counts from 1 in its file, however it is split.

    A task reads the lines of a block of a file in order, so a line's place in its block is its place in the task less that
    of the block's first line. The lines in the file's blocks before are counted by one more pass, which reads and parses
    nothing but line ends; it leaves one row to a block.
    """
    rows = _lines(spark, path)
    ahead = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = blocks.select("file", "block", (F.coalesce(ahead, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    few = rows.rdd.getNumPartitions() <= BROADCAST_BLOCKS
    both = rows.join(F.broadcast(before) if few else before, ["file", "block"])
    return both.select("file", "block", (F.col("at") + F.col("shift")).alias("line"), "value")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, value): ``at`` rises with the lines that a task reads."""
    text = spark.read.option("pathGlobFilter", "*.{jsonl,json}{,.gz}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read(spark: SparkSession, path: str | list[str], schema: StructType, strict: bool = True, numbers: bool = True) -> DataFrame:
    """Records of ``schema``; blank lines are skipped, gzip is read by its extension.

    Strict: a line that is no JSON object raises, naming file, line and text, whatever columns are selected. Without
    ``numbers`` it names the file only, and the lines are not counted beforehand. Not strict: the line is kept in
    ``_corrupt_record``.
    """
    if isinstance(path, str):
        restore(spark, path)
    lines = numbered(spark, path) if strict and numbers else _lines(spark, path).withColumn("line", F.lit(None).cast("long"))
    return parsed(lines, schema, strict)


def parsed(lines: DataFrame, schema: StructType, strict: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """The records in lines of (file, line, value), and the columns ``more`` beside them."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    record = F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT})
    # the generator keeps the line from being parsed once for the check and again for the columns
    rows = lines.where("trim(value) <> ''").select("value", "file", "line", *more, F.explode(F.array(record)).alias("_row"))
    bad = F.when(~F.trim("value").startswith("{"), F.col("value")).otherwise(F.col("_row")[CORRUPT])
    columns = [*(F.col("_row")[f.name].alias(f.name) for f in schema.fields), *more]
    if not strict:
        return rows.select(*columns, bad.alias(CORRUPT))
    place = F.concat_ws(":", F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))), F.col("line").cast("string"))
    error = F.raise_error(F.concat(F.lit("malformed record in "), place, F.lit(": "), F.substring(bad, 1, 80)))
    return rows.where(F.when(bad.isNotNull(), error.cast("boolean")).otherwise(True)).select(*columns)


def files(spark: SparkSession, path: str) -> list[str]:
    """The JSON-lines files (URIs) of a file or folder, in scan order: by name."""
    found = spark.read.option("pathGlobFilter", "*.{jsonl,json}{,.gz}").text(path).inputFiles()
    # local files are file:/x in the metadata column and file:///x in the list
    return sorted((re.sub("^file:/+", "file:/", f) for f in found), key=lambda f: f.rsplit("/", 1)[-1])


def first(spark: SparkSession, path: str, schema: StructType, n: int, strict: bool = True) -> DataFrame:
    """The first ``n`` records in scan order (files by name, then by line), with their ``ordinal`` from 0.

    Opens the files one after another, each turn four times as many, until they hold ``n`` records; no later file is opened
    then or by the result. Of the file with the n-th record, the blocks are counted (one row each comes to the driver), and
    lines behind it are not parsed.
    """
    if n <= 0:
        return parsed(_none(spark), schema, strict, ("ordinal",))
    restore(spark, path)
    todo, taken, held, turn = files(spark, path), [], 0, 1
    while todo and held < n:
        now, todo = todo[:turn], todo[turn:]
        counts = {r.file: r.records for r in _lines(spark, _readable(now)).where("trim(value) <> ''").groupBy("file").agg(F.count("*").alias("records")).collect()}
        for file in now:
            if held < n:
                taken.append((file, held))
                held += counts.get(file, 0)
        turn *= 4
    if not taken:
        return parsed(_none(spark), schema, strict, ("ordinal",))
    # a record's place in its file: those in blocks before it, and those before it in its block
    opened = _readable([f for f, _ in taken])
    rows = _lines(spark, opened).where("trim(value) <> ''")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("records"))
    ahead = F.coalesce(F.sum("records").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spark.createDataFrame(taken, "file string, before long")
    placed = blocks.select("file", "block", ahead.alias("ahead")).join(F.broadcast(starts), "file").select("file", "block", (F.col("before") + F.col("ahead")).alias("start"))
    needed = numbered(spark, opened).where("trim(value) <> ''").join(F.broadcast(placed.where(F.col("start") < n)), ["file", "block"])
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))
    return parsed(needed.withColumn("ordinal", F.col("start") + nth - 1).where(F.col("ordinal") < n), schema, strict, ("ordinal",))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, line long, value string, ordinal long")


def _readable(uris: list[str]) -> list[str]:
    """Paths for the reader, which takes globs, from the file URIs that scans report."""
    return [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(u)) for u in uris]


def read_if_exists(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    restore(spark, path)
    return read(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def restore(spark: SparkSession, path: str) -> None:
    """Puts back what ``write_atomic`` had set aside if it was lost between its two renames."""
    fs, target = _fs(spark, path)
    aside = _fs(spark, path.rstrip("/") + OLD)[1]
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"can't rename {source} to {target}")


def write_atomic(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Writes beside ``path``, sets aside what was there, and renames; returns the number of rows.

    A failure while writing leaves what was there; one between the renames leaves it aside, where ``read`` and the next
    write find it. Refuses to overwrite unasked.
    """
    spark = df.sparkSession
    restore(spark, path)
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    temporary, aside = (_fs(spark, path.rstrip("/") + x)[1] for x in (".tmp", OLD))
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "gzip").json(temporary.toString())
        if fs.exists(target):
            fs.delete(aside, True)
            _rename(fs, target, aside)
        _rename(fs, temporary, target)
        fs.delete(aside, True)
    finally:
        if fs.exists(temporary):
            fs.delete(temporary, True)
    return seen.get["rows"]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "gzip").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, written beside ``path`` and renamed, so that a reader never sees half of it."""
    fs, p = _fs(spark, path)
    made = _fs(spark, f"{path}.tmp")[1]
    out = fs.create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    _rename(fs, made, p)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document."""
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2), path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def update_manifest(spark: SparkSession, path: str, changes: dict) -> dict:
    """Merges ``changes`` into the manifest at ``path``, which may be missing."""
    merged = (read_json(spark, path) if exists(spark, path) else {}) | changes
    write_json(spark, merged, path)
    return merged


def guard_outputs(spark: SparkSession, paths: Iterable[str], overwrite: bool) -> None:
    there = [p for p in paths if exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(", ".join(there))
