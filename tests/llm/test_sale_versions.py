import datetime as dt
import random
import zlib
from collections import defaultdict

import pytest

from tessella.llm import sale_versions
from tessella.llm.queries import op13_sale_versions

T0 = dt.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, batch int, total double, at string"
CHANGES = "change_id long, client_id long, valid_at timestamp_ntz, op string, balance double, batch int, slice string"


def by_hand(sales, changes, n_batches, delay=0):
    """The batches one after another, sale by sale."""
    before = lambda rows, at, b: max((r[at] for r in rows if r["batch"] < b and r[at] is not None), default=None)
    less = lambda t: None if t is None else t - dt.timedelta(hours=delay)
    held, waiting, out = defaultdict(list), [], []
    for b in range(n_batches + 1):
        wc, ws = less(before(changes, "valid_at", b)), less(before(sales, "sold_at", b))
        h = None if wc is None or ws is None else min(wc, ws)
        for c in changes:
            if c["batch"] == b and c["valid_at"] is not None:
                if wc is not None and c["valid_at"] < wc:
                    out.append(("late", c["change_id"], b, None, None, None, None))
                elif c["client_id"] is not None:
                    held[c["client_id"]].append(c)
        waiting += [s for s in sales if s["batch"] == b]
        go = [s for s in waiting if b == n_batches or s["sold_at"] is None or h is not None and s["sold_at"] < h]
        waiting = [s for s in waiting if not any(s is x for x in go)]
        for s in go:
            mine = held.get(s["client_id"], []) if s["client_id"] is not None else []
            fit = [v for v in mine if s["sold_at"] is not None and v["valid_at"] <= s["sold_at"]]
            v = max(fit, key=lambda v: (v["valid_at"], v["change_id"]), default=None)
            cents = None if v is None or v["balance"] is None else int((100 * v["balance"] + 0.5) // 1)
            out.append(("sale", s["sale_id"], b, len(mine), v and v["change_id"], cents, v and v["op"]))
        if h is not None:
            for client, mine in held.items():
                old = sorted((v for v in mine if v["valid_at"] <= h), key=lambda v: (v["valid_at"], v["change_id"]))
                held[client] = old[-1:] + [v for v in mine if v["valid_at"] > h]
    return out


def made(seed, n_sales=700, n_changes=500, n_batches=4):
    rng = random.Random(seed)
    client = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4, 5, None])
    hour = lambda: T0 + dt.timedelta(hours=rng.randrange(240))
    later = lambda t: min(n_batches - 1, max(0, ((t or hour()) - T0).days * 2 // 5 + rng.choice([0, 0, 0, 1, -1])))
    sales, changes = [], []
    for i in range(n_sales):
        t = hour() if rng.random() > 0.03 else None
        sales.append({"sale_id": i % 650 if i % 40 else None, "client_id": client(), "sold_at": t, "batch": later(t), "total": 1.0, "at": "x"})
    for i in range(n_changes):
        t = hour() if rng.random() > 0.03 else None
        b = later(t)
        changes.append({"change_id": i - 20, "client_id": client(), "valid_at": t, "op": rng.choice(["I", "U", "D", None]), "balance": rng.choice([None, round(rng.uniform(-99, 99), 3)]), "batch": b if b != 1 else 2, "slice": "x"})
    return sales, changes


def frames(spark, sales, changes):
    return spark.createDataFrame(sales, SALES).repartition(2), spark.createDataFrame(changes, CHANGES).repartition(2)


@pytest.mark.parametrize(("hot_from", "rows", "delay"), [(10**9, 200_000, 0), (20, 30, 0), (20, 200_000, 7)])
def test_equals_a_loop_over_batches(spark, monkeypatch, hot_from, rows, delay):
    """Without hot clients; with most clients hot, few rows a bucket; with a delay. Batch 1 holds no change at all."""
    monkeypatch.setattr(sale_versions, "HOT_FROM", hot_from)
    monkeypatch.setattr(sale_versions, "ROWS_PER_BUCKET", rows)
    sales, changes = made(delay + rows)
    got = sale_versions.enrich(*frames(spark, sales, changes), 4, delay).collect()
    want = by_hand(sales, changes, 4, delay)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.rec for r in got} == {"sale", "late"} and len({r.batch for r in got if r.rec == "sale"}) > 3
    assert "spark.sql.streaming.stateStore.providerClass" not in {k for k, v in spark.conf.getAll.items() if "RocksDB" in v}


def test_empty_tables(spark):
    sales, changes = made(1, 4, 3, 2)
    none = frames(spark, sales, changes)
    assert sale_versions.enrich(none[0].where("false"), none[1].where("false"), 2).count() == 0
    only = sale_versions.enrich(none[0], none[1].where("false"), 2).collect()
    assert sorted((r.n_held, r.change_id) for r in only) == [(0, None)] * 4


def test_buckets_spread_evenly_and_times_keep_their_clock(spark):
    from pyspark.sql import functions as F

    keys = sale_versions._even_keys(spark, 7, 3)
    parts = spark.createDataFrame([(k,) for k in keys], "id long").groupBy(F.expr("pmod(hash(id), 7)")).count().collect()
    assert [r["count"] for r in parts] == [3] * 7
    one = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00' AS t, CAST(NULL AS TIMESTAMP_NTZ) AS n")
    assert one.select(sale_versions.micros(F.col("t")), sale_versions.day(F.col("n"))).first()[:] == (1711852200000000, None)
    cut = spark.range(1).select(*(sale_versions.batch_of_day(F.lit(d).cast("long"), 12, 19723, 152) for d in (19722, 19723, 19874, 19900, None))).first()
    assert cut[:] == (0, 0, 11, 11, 11)


def test_query_equals_the_loop_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    day = lambda t, b=0: min(11, ((t - dt.datetime(1970, 1, 1)).days + b - 19723) * 12 // 152)
    sales = [{**r.asDict(), "batch": day(r.arrived_at)} for r in spark.read.parquet(f"{sf}/sales.parquet").collect()]
    changes = [r.asDict() for r in spark.read.parquet(f"{sf}/client_changes.parquet").where("valid_at is not null").distinct().collect()]
    for c in changes:
        c["batch"] = day(c["valid_at"], zlib.crc32(str(c["change_id"]).encode()) % 4)
    assert sorted(map(tuple, op13_sale_versions(spark, sf).collect()), key=repr) == sorted(by_hand(sales, changes, 12), key=repr)


def test_state_is_kept_without_native_stores(spark, monkeypatch):
    """A RocksDB store leaves memory outside of the heap behind, at every start and in every state partition."""
    from pathlib import Path

    kinds, drop = set(), sale_versions.StageTables.drop

    def spied(self, table=""):
        if table == "state":
            kinds.update(x.suffix for x in Path(self.path("state/state").removeprefix("file:")).rglob("*") if x.is_file())
        drop(self, table)

    monkeypatch.setattr(sale_versions.StageTables, "drop", spied)
    sales, changes = made(3, 40, 30, 2)
    assert sale_versions.enrich(*frames(spark, sales, changes), 2).count() >= 40
    assert ".delta" in kinds and not kinds & {".changelog", ".zip", ".sst"}
