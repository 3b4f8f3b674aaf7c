"""Valid-time enrichment: every sale takes its client's version at the moment of the sale, batch after batch.

Sales and changes come in numbered batches. A table's watermark is the largest ``sold_at`` or ``valid_at`` of its earlier
batches less ``delay_hours`` (before the first: minus infinity); H is the smaller of the two. In every batch

1. changes below their watermark are late and only reported, others become a version each;
2. new and waiting sales without ``sold_at`` or with ``sold_at < H`` are emitted, others wait; a sale takes the client's
   last version (by ``valid_at``, ``change_id``) with ``valid_at <= sold_at`` among those not pruned, or none;
3. of a client's versions with ``valid_at <= H`` all but the last are pruned.

After the last batch the waiting sales are emitted as one batch more (in the last start).

How it runs. One write deals both tables to batches and buckets. A stateful streaming query (``applyInPandasWithState``)
is started anew for every batch on one checkpoint, and reads the batch's files, which are moved into its source folder.
Clients are hashed to buckets; a bucket holds about ``ROWS_PER_BUCKET`` rows of a batch, and buckets are numbered so that
each state partition gets the same number of them. Every bucket gets one tick per batch with the watermarks, so that
it acts in empty batches too. A bucket's state is columnar: versions of all its clients sorted by (client, slice, time,
id), and waiting sales, as numpy arrays. Sales are resolved together, by one binary search over composite ranks (place of
the client, then rank of the time).

The state store is the one that keeps a partition's state as files of changes and in the heap while a task works on it.
RocksDB keeps memory outside of the heap for every store that was ever opened on an executor, and here every start opens one to
each state partition.

Hot clients. A client with over 1 / ``HOT_SHARE`` of all rows (so at most ``HOT_SHARE`` of them) is cut into slices of
``SLICE_HOURS`` of valid time; each slice is a unit of its own, in a bucket of its own. A slice's bucket answers with the
last version of the slice, and reports per batch how many versions the slice held, its last one, and the last one pruned.
These reports (one per slice and batch, no versions or sales) give afterwards the number of versions held by the client,
and the answer for sales whose slice holds no earlier version. Nothing is copied and no client's rows meet in one task.

Exactly once. Batches are the query's micro-batches; the file sink's log keeps each once. A lost task is read again from
the state of the batch before, so executors may go at any time.

Rows without client hold no version and are dealt by their id. Changes without ``valid_at`` are ignored. Repeated changes
(equal rows) count once, repeated sales each. A batch number of null counts as the last, one outside of the range as the
nearest. Versions that agree in ``valid_at`` and ``change_id`` go by balance and op (null first). Empty tables give no rows.
Only the named columns are read, so names of others can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.llm.common import StageTables, worker_state

ROWS_PER_BUCKET = 200_000
HOT_SHARE = 500
#: Clients of fewer rows are never hot.
HOT_FROM = 2000
SLICE_HOURS = 6
_MIN = -(1 << 63)
_TICK, _CHANGE, _SALE = 0, 1, 2
_NO_CLIENT, _NO_TIME, _NO_ID, _NO_CENTS, _NO_OP, _HOT = 1, 2, 4, 8, 16, 32
#: What is fed: a change's or sale's client, slice, time in microseconds, id, cents and op; what is null, as bits. A tick
#: holds the batch's number as client, the changes' watermark as time and H as id; its slice is 1 in the last batch.
_FED = "bucket long, kind int, client long, slice long, at long, id long, cents long, op string, nulls int"
_OUT = "rec string, id long, batch long, client long, slice long, sold long, hot boolean, n_held long, at long, change_id long, cents long, op string, gone_at long, gone_id long, gone_cents long, gone_op string"


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone (or of the local clock of one with a zone)."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), time.cast("timestamp_ntz"))


def batch_of_day(day: Column, n_batches: int, first_day: int, days: int) -> Column:
    """The batch of a day since 1970 when ``days`` from ``first_day`` are cut into ``n_batches``; null counts as the last."""
    cut = F.floor((day - first_day) * n_batches / days)
    return F.greatest(F.lit(0), F.least(F.lit(n_batches - 1), F.coalesce(cut, F.lit(n_batches - 1)))).cast("int")


def day(time: Column) -> Column:
    return F.floor(micros(time) / 86_400_000_000)


def enrich(sales: DataFrame, changes: DataFrame, n_batches: int, delay_hours: int = 0) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): one row for every sale and every late change.

    ``sales`` has sale_id, client_id, sold_at and batch; ``changes`` has change_id, client_id, valid_at, op, balance and
    batch, and repeats no row.
    """
    spark = sales.sparkSession
    tables = StageTables(spark, "sale-versions")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sold, changed = _sale_rows(sales), _change_rows(changes)
    hot = tables.put("hot", _hot_clients(sold, changed))
    total = hot.where("client is null").first()
    per_batch = (total["times"] if total else 0) // n_batches
    keys = _even_keys(spark, partitions, 1 + per_batch // (partitions * ROWS_PER_BUCKET))
    rows = _dealt(sold.unionByName(changed), hot.where("client is not null"), len(keys)).withColumn("bucket", F.element_at(F.lit(keys), (F.col("bucket") + 1).cast("int")))
    marks = _watermarks(sales, changes, n_batches, delay_hours)
    ticks = spark.createDataFrame([(b, w, h) for b, (w, h) in enumerate(marks)], "feed int, at long, id long")
    ticks = ticks.withColumn("bucket", F.explode(F.lit(keys))).selectExpr("feed", "cast(bucket as long) bucket", f"{_TICK} kind", "cast(feed as long) client", f"cast(feed = {n_batches - 1} as long) slice", "at", "id", "0L cents", "'' op", "0 nulls")
    (rows.unionByName(ticks)).write.partitionBy("feed").parquet(tables.path("dealt"))
    _run_batches(spark, tables, n_batches, partitions)
    out = tables.put("result", _completed(spark.read.schema(_OUT).parquet(tables.path("out")), n_batches))
    for t in ("hot", "dealt", "source", "state", "out"):
        tables.drop(t)
    return out


def _nulls(**flags: tuple[int, Column]) -> Column:
    return sum((F.when(c.isNull(), bit).otherwise(0) for bit, c in flags.values()), F.lit(0))


def _sale_rows(sales: DataFrame) -> DataFrame:
    at = micros(F.col("sold_at"))
    nulls = _nulls(client=(_NO_CLIENT, F.col("client_id")), time=(_NO_TIME, F.col("sold_at")), id=(_NO_ID, F.col("sale_id")))
    return sales.select(F.col("batch").alias("feed"), F.lit(_SALE).alias("kind"), *(F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(x) for x, c in (("client", F.col("client_id")), ("at", at), ("id", F.col("sale_id")))), F.lit(0).cast("long").alias("cents"), F.lit("").alias("op"), nulls.alias("nulls"))


def _change_rows(changes: DataFrame) -> DataFrame:
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    nulls = _nulls(client=(_NO_CLIENT, F.col("client_id")), id=(_NO_ID, F.col("change_id")), cents=(_NO_CENTS, F.col("balance")), op=(_NO_OP, F.col("op")))
    known = changes.where("valid_at is not null")
    return known.select(F.col("batch").alias("feed"), F.lit(_CHANGE).alias("kind"), *(F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(x) for x, c in (("client", F.col("client_id")), ("at", micros(F.col("valid_at"))), ("id", F.col("change_id")), ("cents", cents))), F.coalesce("op", F.lit("")).alias("op"), nulls.alias("nulls"))


def _hot_clients(sold: DataFrame, changed: DataFrame) -> DataFrame:
    """(client, times) of hot clients, and one row without client that holds the number of all rows."""
    known = sold.select("client", "nulls").unionByName(changed.select("client", "nulls"))
    counts = known.groupBy(F.when(F.col("nulls").bitwiseAND(_NO_CLIENT) == 0, F.col("client")).alias("client")).agg(F.count("*").alias("times"))
    total = counts.agg(F.sum("times").alias("total"))
    hot = counts.where("client is not null").join(F.broadcast(total), F.col("times") > F.greatest(F.lit(HOT_FROM), F.col("total") / HOT_SHARE))
    return hot.select("client", "times").unionByName(total.select(F.lit(None).cast("long").alias("client"), F.col("total").alias("times")).where("times is not null"))


def _even_keys(spark: SparkSession, partitions: int, each: int) -> list[int]:
    """Bucket numbers of which Spark's hash partitioning sends ``each`` to every state partition."""
    found = spark.range(0, 40 * partitions * each + 1000).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("p"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("id"))
    return [r.id for r in found.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("id").collect()]


def _dealt(rows: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """The rows with slice and bucket: by client; by client and slice if it is hot; by id without a client."""
    hot = F.broadcast(hot.select(F.col("client").alias("hot_client")))
    both = rows.join(hot, (F.col("client") == F.col("hot_client")) & (F.col("nulls").bitwiseAND(_NO_CLIENT) == 0), "left")
    is_hot = F.col("hot_client").isNotNull()
    timeless = F.col("nulls").bitwiseAND(_NO_TIME) != 0
    by_time = F.when(timeless, _MIN // 2 + F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(F.floor(F.col("at") / (SLICE_HOURS * 3_600_000_000)))
    cut = both.withColumn("slice", F.when(is_hot, by_time).otherwise(0).cast("long"))
    alone = F.col("nulls").bitwiseAND(_NO_CLIENT) != 0
    by = F.when(alone, F.xxhash64("id")).otherwise(F.xxhash64("client", "slice"))
    flagged = F.col("nulls") + F.when(is_hot, _HOT).otherwise(0)
    return cut.select("feed", F.pmod(by, F.lit(buckets)).alias("bucket"), "kind", "client", "slice", "at", "id", "cents", "op", flagged.alias("nulls"))


def _watermarks(sales: DataFrame, changes: DataFrame, n_batches: int, delay_hours: int) -> list[tuple[int, int]]:
    """(watermark of changes, H) for every batch; one row a batch comes to the driver."""
    tops = []
    for table, time in ((sales, "sold_at"), (changes, "valid_at")):
        got = {r.batch: r.top for r in table.groupBy("batch").agg(F.max(micros(F.col(time))).alias("top")).collect()}
        known = [got.get(b) for b in range(n_batches)]
        before = [max((t for t in known[:b] if t is not None), default=None) for b in range(n_batches)]
        tops.append([_MIN if t is None else t - delay_hours * 3_600_000_000 for t in before])
    return [(w, min(s, w)) for s, w in zip(*tops)]


def _run_batches(spark: SparkSession, tables: StageTables, n_batches: int, partitions: int) -> None:
    """Starts the query once per batch; the batch's files are moved into its source folder first."""
    jvm = spark._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(tables.path(x))
    fs = path("source").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path("source"))
    state = "spark.sql.streaming.stateStore."
    conf = {
        f"{state}providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        # Every start has stores of its own: those of the start before are closed and what they hold goes at once.
        f"{state}unloadOnCommit": "true",
        # The file system's own checksums guard the small files of every commit.
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
    }
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for b in range(n_batches):
            fs.rename(path(f"dealt/feed={b}"), path(f"source/b{b:06d}"))
            fed = spark.readStream.schema(_FED).parquet(f"{tables.path('source')}/*")
            found = fed.groupBy("bucket").applyInPandasWithState(_tick, _OUT, _STATE, "Append", GroupStateTimeout.NoTimeout)
            query = found.writeStream.format("parquet").option("path", tables.path("out")).option("checkpointLocation", tables.path("state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: One bucket: the versions of its clients, the ops that their codes stand for, and the sales that wait.
_VERSION = ("client", "slice", "at", "id", "cents", "op", "nulls")
_WAITING = ("client", "slice", "at", "id", "nulls")
_STATE = ", ".join(f"{x} binary" for x in (*(f"v_{x}" for x in (*_VERSION, "ops")), *(f"w_{x}" for x in _WAITING)))


def _tick(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of a bucket."""
    worker_state("sale_versions")  # gives freed memory back
    new = pd.concat(list(rows), ignore_index=True)
    tick = new[new["kind"] == _TICK]
    if len(tick) != 1:
        raise ValueError(f"bucket {key}: {len(tick)} ticks in one batch")
    batch, watermark, h, last = (int(tick[x].iloc[0]) for x in ("client", "at", "id", "slice"))
    held, ops, waiting = _loaded(state)
    changes, sales = new[new["kind"] == _CHANGE], new[new["kind"] == _SALE]
    late = changes["at"].to_numpy() < watermark
    yield from _late_rows(changes[late], batch)
    fresh = changes[~late]
    held = _ordered({x: np.concatenate([held[x], _codes(fresh["op"], ops) if x == "op" else fresh[x].to_numpy(np.int64)]) for x in _VERSION}, ops)
    waiting = {x: np.concatenate([waiting[x], sales[x].to_numpy(np.int64)]) for x in _WAITING}
    for turn in range(1 + last):  # after the last batch, what still waits is emitted as a batch of its own
        now = (waiting["at"] < h) | (waiting["nulls"] & _NO_TIME > 0) | (turn == 1)
        emitted, waiting = ({x: v[chosen] for x, v in waiting.items()} for chosen in (now, ~now))
        units = Units(held)
        yield from _sale_rows_out(emitted, held, ops, units, units.answer(emitted), batch + turn)
        keep, retired = units.pruned(h)
        yield from _reports(held, ops, units, retired, batch + turn)
        held = {x: v[keep] for x, v in held.items()}
    _save(state, held, ops, waiting)


def _loaded(state: GroupState) -> tuple[dict[str, np.ndarray], list[str], dict[str, np.ndarray]]:
    found = [bytes(x) for x in state.get] if state.exists else None
    n = len(_VERSION)
    at = lambda names, start: {x: np.frombuffer(found[start + i] if found else b"", np.int64) for i, x in enumerate(names)}
    return at(_VERSION, 0), json.loads(found[n]) if found else [], at(_WAITING, n + 1)


def _save(state: GroupState, held: dict[str, np.ndarray], ops: list[str], waiting: dict[str, np.ndarray]) -> None:
    if len(held["at"]) or len(waiting["at"]):
        state.update((*(held[x].tobytes() for x in _VERSION), json.dumps(ops).encode(), *(waiting[x].tobytes() for x in _WAITING)))
    elif state.exists:
        state.remove()


def _codes(values: pd.Series, ops: list[str]) -> np.ndarray:
    """The place of every value in ``ops``, to which new ones are added."""
    codes, found = pd.factorize(values)
    known = {x: i for i, x in enumerate(ops)}
    for x in found:
        if x not in known:
            known[x] = len(ops)
            ops.append(x)
    return np.array([known[x] for x in found], np.int64)[codes] if len(found) else np.zeros(0, np.int64)


def _ordered(held: dict[str, np.ndarray], ops: list[str]) -> dict[str, np.ndarray]:
    """Versions with a client, by client, slice, time and id; what agrees in these goes by balance and op, null first."""
    known = held["nulls"] & _NO_CLIENT == 0
    held = {x: v[known] for x, v in held.items()}
    rank = np.argsort(np.argsort(np.array(ops, object), kind="stable"), kind="stable")[held["op"]] if ops else held["op"]
    flags = [held["nulls"] & bit == 0 for bit in (_NO_OP, _NO_CENTS, _NO_ID)]
    by = np.lexsort((rank, flags[0], held["cents"], flags[1], held["id"], flags[2], held["at"], held["slice"], held["client"]))
    return {x: v[by] for x, v in held.items()}


class Units:
    """The sorted versions by unit: a client, or a slice of a hot one."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.held = held
        n = len(held["at"])
        new = np.append(True, (held["client"][1:] != held["client"][:-1]) | (held["slice"][1:] != held["slice"][:-1]))[:n]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.of_version = np.cumsum(new) - 1
        self.client, self.slice = held["client"][self.starts], held["slice"][self.starts]
        self.hot = held["nulls"][self.starts] & _HOT > 0

    def find(self, client: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The unit of every (client, slice), -1 if it holds no version."""
        if not len(self.starts):
            return np.full(len(client), -1)
        clients, first = np.unique(self.client, return_index=True)
        slices = np.unique(self.slice)
        composite = (np.cumsum(np.isin(np.arange(len(self.client)), first)) - 1) * len(slices) + np.searchsorted(slices, self.slice)
        place, part = np.searchsorted(clients, client), np.searchsorted(slices, cut)
        known = (place < len(clients)) & (part < len(slices))
        place, part = np.where(known, place, 0), np.where(known, part, 0)
        known &= (clients[place] == client) & (slices[part] == cut)
        at = np.minimum(np.searchsorted(composite, place * len(slices) + part), len(composite) - 1)
        return np.where(known & (composite[at] == place * len(slices) + part), at, -1)

    def answer(self, sales: dict[str, np.ndarray]) -> np.ndarray:
        """The last version of the sale's unit at or before its time, by one search over (unit, rank of the time); else -1."""
        unit = np.where(sales["nulls"] & _NO_CLIENT > 0, -1, self.find(sales["client"], sales["slice"]))
        self.of_sale = unit
        if not len(self.starts):
            return np.full(len(unit), -1)
        times = np.unique(self.held["at"])
        composite = self.of_version * (len(times) + 1) + np.searchsorted(times, self.held["at"]) + 1
        asked = unit * (len(times) + 1) + np.searchsorted(times, sales["at"], "right")
        found = np.searchsorted(composite, asked, "right") - 1
        timed = sales["nulls"] & _NO_TIME == 0
        return np.where((unit >= 0) & timed & (found >= self.starts[unit]), found, -1)

    def pruned(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        """What is kept, and the last version at or before H of every unit (-1: none), which hot units give away as well."""
        old = self.held["at"] <= h
        last = self.starts + np.bincount(self.of_version[old], minlength=len(self.starts)) - 1
        last = np.where(last >= self.starts, last, -1) if len(self.starts) else last
        keep = ~old
        keep[last[(last >= 0) & ~self.hot]] = True
        return keep, last


def _ints(values: np.ndarray, null: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.ascontiguousarray(values, np.int64), np.ascontiguousarray(null))


def _frame(n: int, **columns) -> pd.DataFrame:
    none = _ints(np.zeros(n, np.int64), np.ones(n, bool))
    names = [x.split()[0] for x in _OUT.split(", ")]
    empty = {"op": [None] * n, "gone_op": [None] * n}
    return pd.DataFrame({x: columns.get(x, empty.get(x, none)) for x in names})


def _version(held: dict[str, np.ndarray], ops: list[str], at: np.ndarray) -> dict:
    """Time, id, cents and op of versions by place; null where the place is -1."""
    none = at < 0
    if not len(held["at"]):
        return {"at": _ints(at, none), "change_id": _ints(at, none), "cents": _ints(at, none), "op": [None] * len(at)}
    null = held["nulls"][at]
    op = np.array([*ops, None], object)[np.where(none | (null & _NO_OP > 0), len(ops), held["op"][at])]
    return {"at": _ints(held["at"][at], none), "change_id": _ints(held["id"][at], none | (null & _NO_ID > 0)), "cents": _ints(held["cents"][at], none | (null & _NO_CENTS > 0)), "op": op}


def _late_rows(changes: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    n = len(changes)
    if n:
        yield _frame(n, rec=["late"] * n, id=_ints(changes["id"].to_numpy(), changes["nulls"].to_numpy() & _NO_ID > 0), batch=np.full(n, batch), hot=np.zeros(n, bool))


def _sale_rows_out(sales, held, ops, units: Units, at: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
    n = len(at)
    if n:
        count = np.append(units.ends - units.starts, 0)[units.of_sale]
        fine = np.zeros(n, bool)
        yield _frame(n, rec=["sale"] * n, id=_ints(sales["id"], sales["nulls"] & _NO_ID > 0), batch=np.full(n, batch), client=_ints(sales["client"], fine), slice=_ints(sales["slice"], fine), sold=_ints(sales["at"], sales["nulls"] & _NO_TIME > 0), hot=sales["nulls"] & _HOT > 0, n_held=_ints(count, fine), **_version(held, ops, at))


def _reports(held, ops, units: Units, retired: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
    """Of every slice of a hot client that held versions: how many, the last one, and the last one pruned."""
    hot = np.flatnonzero(units.hot)
    if len(hot):
        n = len(hot)
        gone = {f"gone_{x.removeprefix('change_')}": v for x, v in _version(held, ops, retired[hot]).items()}
        fine = np.zeros(n, bool)
        yield _frame(n, rec=["slice"] * n, batch=np.full(n, batch), client=_ints(units.client[hot], fine), slice=_ints(units.slice[hot], fine), hot=~fine, n_held=_ints((units.ends - units.starts)[hot], fine), **_version(held, ops, units.ends[hot] - 1), **gone)


_FACTS = ("at", "change_id", "cents", "op")


def _struct(*columns: Column) -> Column:
    return F.when(columns[0].isNotNull(), F.struct(*(c.alias(x) for c, x in zip(columns, _FACTS))))


def _completed(out: DataFrame, n_batches: int) -> DataFrame:
    """The result. Sales of hot clients get, besides what their slice says, what the reports say of earlier slices."""
    cold = out.where("rec = 'late' or rec = 'sale' and not hot").select("rec", "id", "batch", "n_held", "change_id", F.col("cents").alias("balance_cents"), "op")
    reports, sales = out.where("rec = 'slice'"), out.where("rec = 'sale' and hot")
    own = _struct(*(F.col(x) for x in _FACTS))
    gone = _struct(*(F.col(f"gone_{x}") for x in ("at", "id", "cents", "op")))
    # Per client and batch: versions held in slices, and the last one pruned in any batch before.
    per_batch = reports.groupBy("client", "batch").agg(F.sum("n_held").alias("held"), F.max(gone).alias("gone"))
    asked = sales.select("client", "batch").distinct()
    earlier = asked.join(per_batch.select("client", F.col("batch").alias("b"), "held", "gone"), "client", "left").groupBy("client", "batch").agg(
        F.max(F.when(F.col("b") == F.col("batch"), F.col("held"))).alias("held"), F.max(F.when(F.col("b") < F.col("batch"), F.col("gone"))).alias("kept"))
    # Per client, batch and slice: the last version held in slices before it.
    places = sales.select("client", "batch", "slice").distinct().join(reports.select("client", "batch", "slice", own.alias("last")), ["client", "batch", "slice"], "full")
    before = F.max("last").over(Window.partitionBy("client", "batch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    placed = places.select("client", "batch", "slice", before.alias("before"))
    known = sales.select("id", "batch", "client", "slice", "sold", own.alias("own")).join(F.broadcast(earlier), ["client", "batch"], "left").join(placed, ["client", "batch", "slice"], "left")
    timed = lambda v: F.when(F.col("sold").isNotNull() & (F.col(v)["at"] <= F.col("sold")), F.col(v))
    best = F.greatest(F.col("own"), timed("before"), timed("kept"))
    n_held = F.coalesce("held", F.lit(0)) + F.when(F.col("kept").isNotNull(), 1).otherwise(0)
    full = known.select(F.lit("sale").alias("rec"), "id", "batch", n_held.cast("long").alias("n_held"), best.alias("v")).select("rec", "id", "batch", "n_held", "v.change_id", F.col("v.cents").alias("balance_cents"), "v.op")
    return cold.unionByName(full)
