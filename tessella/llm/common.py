"""What the training-data operators share: the shared folder, stage tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests, one machine) a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class StageTables:
    """Tables written to the shared folder to cut lineage; they outlive a lost executor.

    ``put`` writes and rereads; ``drop`` deletes a table once nothing lazy reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, table: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(table))
        return self.get(table, df)

    def get(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, table: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def text_batches(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, max_chars: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of at most ``max_chars`` characters each; a longer text comes alone, whole. Null text is empty."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        keys, values = batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col))
        for i in range(batch.num_rows):
            text = values[i].as_py() or ""
            if texts and held + len(text) > max_chars:
                yield pa.array(ids, keys.type), texts
                ids, texts, held = [], [], 0
            ids.append(keys[i].as_py())
            texts.append(text)
            held += len(text)
    if ids:
        yield pa.array(ids, keys.type), texts


_STATE: dict = {}
_MMAP_THRESHOLD = -3


def worker_state(operator: str, make: Callable[[], object] | None = None):
    """What an operator keeps from task to task in a Python worker, such as its caches: one operator's at a time.

    Workers serve one stage after another; what the last operator kept goes before the next one fills its own.
    """
    if operator not in _STATE:
        _STATE.clear()
        gc.collect()
    # What earlier tasks have freed goes back to the system.
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 1 << 18)  # arrays from 256 KB on are mapped, and so given back when freed
        libc.malloc_trim(0)
    if operator not in _STATE:
        _STATE[operator] = make() if make else None
    return _STATE[operator]


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of an id column's Spark type."""
    if kind.startswith("decimal"):
        return pa.decimal128(*(int(x) for x in kind[8:-1].split(",")))
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "binary": pa.binary()}[kind]


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that no other column of the input can clash."""
    short_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


TEXT_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows to an Arrow batch to ``TEXT_ROWS``: texts make the usual 10,000 rows tens or hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped``; null ids stay.

    The ids are written first and counted: up to ``BROADCAST_IDS`` of them are broadcast, so that texts stay where they
    are; more are joined by a shuffle.
    """
    ids = StageTables(docs.sparkSession, name).put("ids", dropped.select(id_col).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti")


def filter_rows(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``keep(texts)`` gives true, all columns as they are; no shuffle."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            start = 0
            while start < batch.num_rows:
                stop, held = start, 0
                while stop < batch.num_rows and held < 1_000_000:
                    held += len(texts[stop].as_py() or "")
                    stop += 1
                part = batch.slice(start, stop - start)
                yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))
                start = stop

    return docs.mapInArrow(run, docs.schema)
