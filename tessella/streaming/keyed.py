"""Work that is done once per (stage, skill_id, source_hash), with state that remembers what is done.

Rows of (stage, skill_id, source_hash, ordinal, prompt) come in batches or as a stream. A key that is done is skipped; of
rows of one key that come together, the first by ordinal is tried and the others are skipped; a key that has failed is tried
again when it comes again. A row without prompt (``with_contracts`` found no contract) fails with 0 attempts, uncalled.

A stream (``run_stream``) keeps the keys in state, by ``transformWithStateInPandas``: no micro-batch reads what earlier ones
wrote, and after a restart the checkpoint says what is done. A batch (``run_batch``) gets the done keys as a table.

Records: status is ``result`` or ``failure``; of a failure, raw_response is the last answer that was refused and finish_reason
what the client said of it. ``failures`` leaves out those that were resolved later.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.streaming.inflight import in_order, limited

KEY = ["stage", "skill_id", "source_hash"]
RECORD = "stage string, skill_id string, source_hash string, status string, response string, attempts int, error_type string, error string, raw_response string, finish_reason string"
_ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in RECORD.split(", ")])
NO_CONTRACT = "no contract for this source hash"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Config(NamedTuple):
    max_attempts: int = 3
    backoff: float = 0.0
    #: Calls that a task has in flight.
    width: int = 16
    buckets: int = 64


class Answer(str):
    """A client's answer with what it says of the answer's end."""

    finish_reason: str | None = None


def with_contracts(skills: DataFrame, contracts: DataFrame) -> DataFrame:
    """``skills`` with the contract of the same skill_id and source_hash, null where there is none."""
    keyed = contracts.groupBy("skill_id", "source_hash").agg(F.max("contract").alias("contract"))
    return skills.join(keyed, ["skill_id", "source_hash"], "left")


class Worker(NamedTuple):
    """``call(prompt, feedback)`` answers; ``accept(row, answer)`` makes the response of it or raises."""

    call: Callable[[str, str | None], str]
    accept: Callable[[dict, str], str] = lambda row, answer: answer

    def attempt(self, row: dict, config: Config) -> dict:
        """The row's record. A ``ValueError`` goes into the next prompt; waits between attempts, twice as long each time, 8 s at most."""
        out = {x: row[x] for x in KEY} | {"status": "failure", "attempts": 0}
        if row["prompt"] is None:
            return out | {"error_type": "ValueError", "error": NO_CONTRACT}
        feedback = None
        for n in range(1, config.max_attempts + 1):
            answer = None
            try:
                answer = self.call(row["prompt"], feedback)
                return {x: row[x] for x in KEY} | {"status": "result", "attempts": n, "response": self.accept(row, answer)}
            except Exception as e:  # whatever is raised is this row's failure
                feedback = f"{type(e).__name__}: {e}" if isinstance(e, ValueError) else None
                out |= {"attempts": n, "error_type": type(e).__name__, "error": str(e), "raw_response": None if answer is None else str(answer), "finish_reason": getattr(answer, "finish_reason", None)}
                if config.backoff > 0 and n < config.max_attempts:
                    time.sleep(min(config.backoff * 2 ** (n - 1), 8))
        return out

    def records(self, rows: Iterable[dict], config: Config) -> Iterator[dict]:
        for row, record, error in in_order(lambda r: self.attempt(r, config), rows, config.width):
            if error is not None:
                raise error
            yield record


# ---- batch ------------------------------------------------------------------------------------------------------------
def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The first row by ordinal of each key that isn't done."""
    once = rows.groupBy(*KEY).agg(F.min_by("prompt", "ordinal").alias("prompt"), F.min("ordinal").alias("ordinal"))
    return once.join(done.select(*KEY).distinct(), KEY, "left_anti")


def run_batch(rows: DataFrame, done: DataFrame, worker: Worker, config: Config = Config(), total: int | None = None) -> DataFrame:
    """Records of the pending rows, with at most ``total`` calls in flight on the cluster."""
    todo = pending(rows, done).select(*KEY, "prompt")
    todo = limited(todo, total, config.width) if total else todo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(worker.records(batch.to_pylist(), config)), schema=_ARROW)

    return todo.mapInArrow(run, RECORD)


def failures(records: DataFrame) -> DataFrame:
    """The failures of keys without a result, the last of each key by attempts."""
    failed = records.where("status = 'failure'").groupBy(*KEY).agg(F.max_by(F.struct("attempts", "error_type", "error", "raw_response", "finish_reason"), "attempts").alias("f"))
    return failed.join(results(records), KEY, "left_anti").select(*KEY, "f.*")


def results(records: DataFrame) -> DataFrame:
    return records.where("status = 'result'").select(*KEY, "response", "attempts")


def counts(rows: DataFrame, records: DataFrame) -> DataFrame:
    """One row of what a run did: attempted, succeeded, skipped, failed."""
    seen = rows.agg(F.count("*").alias("rows"))
    made = records.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "result").alias("succeeded"))
    return seen.crossJoin(made).select("attempted", "succeeded", (F.col("rows") - F.col("attempted")).alias("skipped"), (F.col("attempted") - F.col("succeeded")).alias("failed"))


# ---- stream -----------------------------------------------------------------------------------------------------------
class Keyed(StatefulProcessor):
    """One bucket of keys: its state maps each key to the attempts made and whether it is done."""

    def __init__(self, worker: Worker, config: Config):
        self.worker, self.config = worker, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._keys = handle.getMapState("keys", "stage string, skill_id string, source_hash string", "attempts int, done boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows), ignore_index=True).sort_values("ordinal", kind="stable").drop_duplicates(KEY)
        before: dict[tuple, int] = {}

        def open_rows() -> Iterator[dict]:
            for row in come[[*KEY, "prompt"]].to_dict("records"):
                at = tuple(row[x] for x in KEY)
                attempts, done = self._keys.getValue(at) if self._keys.containsKey(at) else (0, False)
                if not done:
                    before[at] = attempts
                    yield row | {"prompt": row["prompt"] if isinstance(row["prompt"], str) else None}

        found = list(self.worker.records(open_rows(), self.config))
        for record in found:
            at = tuple(record[x] for x in KEY)
            record["attempts"] += before[at]
            self._keys.updateValue(at, (record["attempts"], record["status"] == "result"))
        if found:
            yield pd.DataFrame({x: pd.Series([r.get(x) for r in found], dtype="int32" if x == "attempts" else object) for x in _ARROW.names})


def run_stream(rows: DataFrame, worker: Worker, out: str, checkpoint: str, config: Config = Config(), query_name: str | None = None) -> StreamingQuery:
    """Works through all rows there are; records are appended to ``out`` as Parquet, each exactly once.

    Needs the RocksDB state store (``state_store``). Attempts are counted over all times that a key came.
    """
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(config.buckets))).groupBy("bucket")
    found = keyed.transformWithStateInPandas(Keyed(worker, config), RECORD, "Append", "None")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.queryName(query_name) if query_name else writer).trigger(availableNow=True).start()


class state_store:  # noqa: N801
    """Within it, streaming queries of the session keep their state in RocksDB."""

    CONF: dict[str, Any] = {"spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.unloadOnCommit": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.was = {k: self.spark.conf.get(k, None) for k in self.CONF}
        for k, v in self.CONF.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.was.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
