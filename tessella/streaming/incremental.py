"""Incremental work: rows that are not done yet go through an injected worker, results and failures are appended.

The same step serves one batch or a file stream (``foreachBatch``). A row is done when its key and source hash are among
the results, so a rerun after a crash repeats nothing that was written; failures of rows that succeed later are pruned.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT = "skill_id string, source_hash string, response string, attempts int, error_type string, error string"


def attempt(work: Callable[[str, str | None], str], prompt: str, max_attempts: int, backoff: float) -> tuple[str | None, int, str | None, str | None]:
    """(response, attempts, error type, error): tries again with the error as feedback where it was a ``ValueError``."""
    feedback: str | None = None
    error: Exception | None = None
    for n in range(1, max_attempts + 1):
        try:
            return work(prompt, feedback), n, None, None
        except Exception as e:  # whatever the worker raises is the row's failure
            error = e
            feedback = str(e) if isinstance(e, ValueError) else None
            if n < max_attempts and backoff > 0:
                time.sleep(min(backoff * 2 ** (n - 1), 8))
    return None, max_attempts, type(error).__name__, str(error)


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose (skill_id, source_hash) isn't done, each key once."""
    return rows.dropDuplicates(["skill_id", "source_hash"]).join(done.select("skill_id", "source_hash").distinct(), ["skill_id", "source_hash"], "left_anti")


def run_batch(rows: DataFrame, done: DataFrame, work: Callable[[str, str | None], str], max_attempts: int = 3, backoff: float = 0.0, partitions: int | None = None) -> DataFrame:
    """Results and failures (``error`` set) of the pending rows of (skill_id, source_hash, prompt)."""
    todo = pending(rows, done).select("skill_id", "source_hash", "prompt")
    todo = todo.repartition(partitions) if partitions else todo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                response, n, kind, error = attempt(work, r["prompt"], max_attempts, backoff)
                out.append({"skill_id": r["skill_id"], "source_hash": r["source_hash"], "response": response, "attempts": n, "error_type": kind, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("skill_id", pa.string()), ("source_hash", pa.string()), ("response", pa.string()), ("attempts", pa.int32()), ("error_type", pa.string()), ("error", pa.string())]))

    return todo.mapInArrow(run, RESULT)


def prune_failures(failures: DataFrame, done: DataFrame) -> DataFrame:
    return failures.join(done.select("skill_id", "source_hash").distinct(), ["skill_id", "source_hash"], "left_anti")


def counters(rows: DataFrame, results: DataFrame) -> DataFrame:
    """One row: attempted, succeeded, skipped, failed."""
    total = rows.agg(F.count("*").alias("total"))
    made = results.agg(F.count("*").alias("attempted"), F.count("response").alias("succeeded"))
    return total.crossJoin(made).select("attempted", "succeeded", (F.col("total") - F.col("attempted")).alias("skipped"), (F.col("attempted") - F.col("succeeded")).alias("failed"))


def run_stream(rows: DataFrame, work: Callable[[str, str | None], str], out: str, checkpoint: str, max_attempts: int = 3) -> StreamingQuery:
    """Works through a stream of (skill_id, source_hash, prompt); results are appended to ``out`` as Parquet.

    Each micro-batch leaves out what ``out`` already holds, so a batch that is run again after a failure adds nothing twice.
    """
    spark: SparkSession = rows.sparkSession
    spark.createDataFrame([], RESULT).write.mode("append").parquet(out)

    def step(batch: DataFrame, _: int) -> None:
        done = batch.sparkSession.read.schema(RESULT).parquet(out).where("response is not null")
        run_batch(batch, done, work, max_attempts).write.mode("append").parquet(out)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
