"""SimHash near-duplicates: 64-bit fingerprints that differ in at most two bits are linked; links give components.

Words are runs of characters other than blank and U+0009 to U+000D after lower-casing A-Z. Shingles are ``k`` words joined
by a blank, repeats included (a text of fewer words is one shingle). A fingerprint bit is set if it is set in over half of
the shingles' XXH64 values (seed 42). A text without words has the fingerprint zero, which links like any other.

Search by deletion variants. Rows of one fingerprint are one node from the start, so copies cost nothing. The 64 bits are
cut into two segments of 32. Of two fingerprints at a distance of two or less, one segment

* is equal: they share the exact variant of that segment; or
* both segments differ in one bit: they share the variant of the first with that bit taken out, and one has it set.

Every fingerprint is indexed under its 2 exact variants and the 32 one-wildcard variants of the first segment. An equality
join pairs those of a variant, in a wildcard variant only the ones with the bit against those without; pairs are verified
on all 64 bits.

A variant is a window of bits that are still free, a wildcard, and the values of all other bits. One with more than
``MOST_PAIRS`` pairs (a dense cluster of near copies, or a common segment) is not joined but cut again in the same way: its
window is halved, and its members go to the variants of the halves. At a window of 4 bits it has at most 32 members. So no
group's pairs are all emitted, and no pair is lost.

Null text is empty. Rows that repeat an id are rows of their own. A row without id has a fingerprint and counts in no
minimum; its component is null if no row with an id is reachable. Ties: a component is named by its smallest id. Very long
texts are hashed whole, their bits counted in pieces. Empty tables give no rows. Columns other than id and text are not
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import StageTables, text_batches, two_columns, worker_state
from tessella.llm.jaccard_join import connected

SEED = 42
RADIUS = 2
#: Pairs of a variant that are joined; one with more is cut again.
MOST_PAIRS = 1024
#: Fingerprints with over 1 / HOT_SHARE of all rows, HOT_SHARE at most, are joined by broadcast.
HOT_SHARE = 1000
_BITS_AT_ONCE = 50_000


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of every ``k``-word shingle of the whole text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(k, len(words))
    shingles = map(line.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[start : start + _BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, in one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for ids, texts in text_batches(batches, "doc_id", "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(shingle_hashes(t, k)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    tables = StageTables(docs.sparkSession, "simhash")
    facts = tables.put("facts", fingerprints(docs, k, id_col, text_col))
    nodes = tables.put("nodes", facts.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    links = tables.put("links", near_pairs(nodes.select("fp"), tables))
    labels = connected(links, tables, "components-")
    named = nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    out = tables.put("result", _joined(facts, tables.put("named", named.join(least, "label").select("fp", "times", "component_id"))))
    for t in ("facts", "nodes", "links", "named"):
        tables.drop(t)
    return out


def _joined(facts: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with its component: those of the few hot fingerprints by broadcast, the others by a shuffle."""
    total = named.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("times") > max(1000, total // HOT_SHARE)).drop("times"))
    rest = named.where(F.col("times") <= max(1000, total // HOT_SHARE)).drop("times")
    return facts.join(hot, "fp").unionByName(facts.join(hot, "fp", "left_anti").join(rest, "fp")).select("doc_id", "fp", "component_id")


def near_pairs(fps: DataFrame, tables: StageTables) -> DataFrame:
    """(x, y), x < y: all pairs of the distinct values ``fp`` that differ in ``RADIUS`` bits or fewer."""
    members = fps.select("fp", *(F.lit(x).alias(name) for name, x in (("low", 0), ("width", 64), ("wild", -1))))
    found, level = [], 0
    while True:
        level += 1
        members = _variants(members)
        asked = tables.put(f"variants{level}", _live(members))
        joined = asked.where((F.col("pairs") <= MOST_PAIRS) | (F.col("width") <= 4))
        cut = asked.where((F.col("pairs") > MOST_PAIRS) & (F.col("width") > 4))
        found.append(tables.put(f"pairs{level}", _paired(members.join(joined.drop("pairs"), _KEY))))
        if cut.isEmpty():
            break
        members = tables.put(f"cut{level}", members.join(cut.drop("pairs"), _KEY)).drop("rest")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


_KEY = ["low", "width", "wild", "rest"]


def _bits(low: Column, width: Column) -> Column:
    """A mask of ``width`` bits (32 at most) from bit ``low``."""
    return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1, low)


def _variants(members: DataFrame) -> DataFrame:
    """The members under the variants of their halved windows: (fp, low, width, wild, rest).

    ``low`` and ``width`` are the bits still free, ``wild`` the wildcard (-1: none), ``rest`` the values of all others.
    A half whose bits become known is the upper one, the lower one, or the lower one but for one bit of it.
    """
    half = (F.col("width") / 2).cast("int")
    window = lambda low, wild: F.struct(low.alias("low"), half.alias("width"), wild.alias("wild"))
    exact = F.array(window(F.col("low"), F.col("wild")), window(F.col("low") + half, F.col("wild")))
    wild = F.transform(F.sequence(F.col("low"), F.col("low") + half - 1), lambda i: window(F.col("low") + half, i))
    spread = members.select("fp", F.explode(F.when(F.col("wild") < 0, F.concat(exact, wild)).otherwise(exact)).alias("v")).select("fp", "v.*")
    free = _bits(F.col("low"), F.col("width")).bitwiseOR(F.when(F.col("wild") >= 0, _bits(F.col("wild"), F.lit(1))).otherwise(F.lit(0).cast("long")))
    return spread.withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not(free)))


def _side() -> Column:
    """Whether the wildcard's bit is set; false without one."""
    return (F.col("wild") >= 0) & (F.col("fp").bitwiseAND(_bits(F.greatest("wild", F.lit(0)), F.lit(1))) != 0)


def _live(members: DataFrame) -> DataFrame:
    """The variants that hold at least one pair, with the number of their pairs."""
    one, all_ = F.count_if(_side()), F.count("*")
    counted = members.groupBy(*_KEY).agg(all_.alias("all"), one.alias("one"))
    pairs = F.when(F.col("wild") < 0, (F.col("all") - 1) * F.col("all") / 2).otherwise((F.col("all") - F.col("one")) * F.col("one"))
    return counted.select(*_KEY, pairs.cast("long").alias("pairs")).where("pairs > 0")


def _paired(members: DataFrame) -> DataFrame:
    left = members.select(*_KEY, F.col("fp").alias("a"), _side().alias("set"))
    right = left.withColumnsRenamed({"a": "b", "set": "other"})
    whole = F.when(F.col("wild") < 0, F.col("a") < F.col("b")).otherwise(~F.col("set") & F.col("other"))
    near = left.join(right, _KEY).where(whole & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    return near.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
