"""Similarity join of word n-gram sets by Jaccard, with filters under several global token orders.

Words are runs of characters other than blank and U+0009 to U+000D after lower-casing A-Z; a document's set holds its
distinct ``k``-word shingles as 64-bit hashes (with fewer words, the whole sequence is one shingle; without words the set
is empty and links with nothing). Two sets link when ``den * |x & y| >= num * |x | y|``. Rows of equal sets are one node,
named by the hash of the set.

1. One pass hashes every text to its set: (id, size, hash of the set, and a sketch of 256 bits that holds the parity of the
   shingles falling on each bit, so two sets differ in at least as many shingles as bits), and marks every shingle that
   two different sets of one batch of texts hold. The marks are a bit map of ``2 ** MARK_BITS`` bits, joined over all tasks and broadcast at
   that fixed size. Global order A puts unmarked (rare) shingles first, then goes by hash; orders B and C have the same
   two classes and go by two keyed permutations of the hash.
2. A second pass writes each set's prefix under order A: any two linked sets of n shingles share one of the first
   ``n - ceil(num * n / den) + 1``. Postings (token, set, size, place) travel packed, many to a row, to the bucket of their
   token; a bucket keeps those of tokens that two different sets hold. Copies are skipped inside a task.
3. Candidate pairs share a token and lie in different components. Pivot rounds pair the nodes of a token with one
   pivot only, by their commonest tokens, which joins large groups of near copies by stars; a last round pairs all that is
   still apart under every token. The join's own condition holds the filters on size, on the places of the token (what is
   left behind it in either set must suffice) and on the sketches, so pairs that fail them are never emitted; pairs of
   large sets then pass a wider sketch. The last round leaves a pair out under a token if it meets under an earlier one
   that is among the first shared tokens of both sets, so long copies aren't emitted once for each token they share.
4. The ends of these pairs, few of all sets, are worked out once more from the text of one row each: the pairs must share a
   prefix token under B and one under C (32 bits of it); the sets of those that do are joined and intersected exactly.
5. Links give components by minimum labels and pointer jumping, and a component's smallest id goes to its rows.

Every pair that could link is verified or already connected. Hot tokens, sets and components are salted or aggregated
before they are joined; nothing that grows with the input goes to the driver. Stage tables are in the shared folder. A
wrong result needs a collision of 64-bit hashes within one pair of sets, or of two sets' hashes: with a billion different
sets the chance of one such is about three in a hundred.

Null text is empty. Rows that repeat an id are nodes of their own. A row without id has a size, links with nothing and has
a null component. Very long texts are hashed whole; one text is the least that a batch holds. Empty tables give no rows.
Columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import StageTables, arrow_type, text_batches, two_columns, worker_state

MARK_BITS = 26
SEEN_SETS = 1_000_000
BROADCAST_NODES = 500_000
HOT_SHARE = 2000
SALTS = 64
PIVOT_TURNS = 2
#: Of a set's shared tokens, those that pivot rounds use.
PIVOT_TOKENS = 6
#: Of a set's shared tokens, the first ones that tell in the last round whether a pair met before.
FIRST_TOKENS = 8
#: Sets of more shingles have a second sketch, of this many bits.
WIDE_FROM, WIDE_BITS = 600, 4096
#: Postings that a bucket's reducer takes in before it sorts them.
POSTINGS_AT_ONCE = 1_000_000
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_B, _C = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


@dataclass(frozen=True)
class Rule:
    """``k``-word shingles; linked at ``num / den`` or more."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def near(self, n: str, m: str, at: str, other_at: str) -> Column:
        """Filters on the sizes and on the places (from 0) of the first shared token in both sets."""
        x, y = F.col(n).cast("long"), F.col(m).cast("long")
        left = F.least(x - F.col(at), y - F.col(other_at))
        return (F.least(x, y) * self.den >= F.greatest(x, y) * self.num) & (left * (self.num + self.den) >= (x + y) * self.num)

    def short(self) -> Column:
        """Whether a token is in the part of the prefix within which a set shares one with any linked set of its size or more."""
        n = F.col("n").cast("long")
        return (n - F.col("at")) * (self.num + self.den) >= n * (2 * self.num)

    def alike(self, n: str, m: str) -> Column:
        """Filter on the sketches: linked sets differ in at most (den - num) / (den + num) of both sizes together."""
        bits = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(4)), F.lit(0))
        return bits.cast("long") * (self.num + self.den) <= (F.col(n) + F.col(m)).cast("long") * (self.den - self.num)

    def alone(self, n: int) -> bool:
        """Whether only an identical set can link: even one shingle more beside ``n`` shared ones is too many."""
        return n == 0 or self.den * n < self.num * (n + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P2
    return x ^ (x >> np.uint64(29))


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(h))
    acc = h[: len(h) - width + 1] + np.uint64(width)
    for j in range(1, width):
        acc = mix(acc * _P1) + h[j : len(h) - width + 1 + j]
    return np.unique(mix(acc * _P3))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def mark_at(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(13)) & np.uint64((1 << MARK_BITS) - 1)


def add_marks(marks: np.ndarray, sets: list[np.ndarray]) -> None:
    """Marks the shingles that at least two of the (different) sets hold."""
    found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    at = mark_at(found[times > 1])
    np.bitwise_or.at(marks, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))


def ordered(s: np.ndarray, marks: np.ndarray, n: int, key: np.uint64 = np.uint64(0)) -> np.ndarray:
    """The first ``n`` shingles under a global order: unmarked ones first, then by hash (A) or its permutation by ``key``."""
    at = mark_at(s)
    common = (marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    if key:
        s = mix((s ^ key) * _P1)
        by = np.argsort(s, kind="stable")
        s, common = s[by], common[by]
    return np.concatenate([s[~common], s[common]])[:n]


def sketch(s: np.ndarray, bits: int = 256) -> np.ndarray:
    """Longs: the parity of the number of shingles on each bit."""
    times = np.bincount((s >> np.uint64(41)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(times).view(np.int64)


def similarity_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    rows = two_columns(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    tables = StageTables(spark, "jaccard")
    facts, marks = _facts(rows, kind, rule, tables)
    shared = spark.sparkContext.broadcast(marks.tobytes())
    nodes = tables.put("nodes", facts.where("set is not null").groupBy("set", "n").agg(F.min("doc_id").alias("doc_id"), *(F.first(x).alias(x) for x in ("s0", "s1", "s2", "s3", "wide"))))
    postings = _shared_postings(rows, nodes, rule, shared, tables)
    labels = _link(rows, nodes, postings, rule, shared, tables)
    out = tables.put("result", _named(facts, labels))
    shared.unpersist()
    for t in ("facts", "nodes", "postings", "labels"):
        tables.drop(t)
    return out


def _named(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the smallest id of its component; components are aggregated to (component, salt) first."""
    named = facts.join(_few(labels), facts["set"] == labels["id"], "left").select("doc_id", "n", F.coalesce("label", "set").alias("component"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS * 4)).alias("salt"))
    part = named.where("component is not null").groupBy("component", "salt").agg(F.min("doc_id").alias("least"))
    spread = part.select("component", "salt").join(part.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return named.join(spread, ["component", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _facts(rows: DataFrame, kind: str, rule: Rule, tables: StageTables) -> tuple[DataFrame, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("jaccard_join")
        marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
        for ids, texts in text_batches(batches, "doc_id", "text", 2_000_000):
            sets = [shingles(t, rule.k) for t in texts]
            hashes = [set_hash(s) if len(s) and i.is_valid else None for i, s in zip(ids, sets)]
            add_marks(marks, list({h: s for h, s in zip(hashes, sets) if h is not None}.values()))
            n = pa.array([len(s) for s in sets], pa.int64())
            bits = np.concatenate([sketch(s) for s in sets]).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": n, "set": pa.array(hashes, pa.int64()), "mark": pa.array([False] * len(ids), pa.bool_()), **{f"s{i}": bits[:, i].copy() for i in range(4)}, "wide": pa.array([sketch(s, WIDE_BITS) if len(s) > WIDE_FROM else None for s in sets], pa.list_(pa.int64()))})
        at = np.flatnonzero(marks)
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(part), arrow_type(kind)), "n": part, "set": signed(marks[part]), "mark": pa.array([True] * len(part), pa.bool_()), **{f"s{i}": np.zeros(len(part), np.int64) for i in range(4)}, "wide": pa.nulls(len(part), pa.list_(pa.int64()))})

    both = tables.put("facts", rows.mapInArrow(run, f"doc_id {kind}, n long, set long, mark boolean, s0 long, s1 long, s2 long, s3 long, wide array<long>"))
    marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    got = both.where("mark").groupBy("n").agg(F.bit_or("set").alias("bits")).toPandas()
    marks[got["n"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return both.where("not mark").drop("mark"), marks


_POSTING = [("token", np.uint64), ("set", np.int64), ("n", np.int32), ("at", np.int32)]


def _shared_postings(rows: DataFrame, nodes: DataFrame, rule: Rule, shared, tables: StageTables) -> DataFrame:
    """(token, set, n, at, s0..s3, nth): prefix postings under order A of tokens that at least two different sets hold.

    ``nth`` is the token's place among the shared ones of its set, the commonest of its short prefix first.
    """
    tokens = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * F.lit(rule.num) / F.lit(rule.den)) + 1)).first()[0] or 0
    buckets = max(2 * int(tables.spark.conf.get("spark.sql.shuffle.partitions")), int(tokens) // POSTINGS_AT_ONCE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("jaccard_join")
        marks, seen = np.frombuffer(shared.value, np.uint64), set()
        for _, texts in text_batches(batches, "doc_id", "text", 2_000_000):
            keys, sizes, prefixes = [], [], []
            for t in texts:
                s = shingles(t, rule.k)
                if rule.alone(len(s)) or (key := set_hash(s)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                sizes.append(len(s))
                prefixes.append(ordered(s, marks, rule.prefix(len(s))))
            if not keys:
                continue
            long = np.array([len(x) for x in prefixes])
            token = np.concatenate(prefixes)
            columns = (token, np.repeat(np.array(keys, np.int64), long), np.repeat(np.array(sizes, np.int32), long), (np.arange(len(token)) - np.repeat(np.cumsum(long) - long, long)).astype(np.int32))
            bucket = ((token >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[by], return_index=True)
            cuts = [*starts.tolist(), len(by)]
            packed = {name: pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for (name, _), c in zip(_POSTING, (c[by] for c in columns))}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int64()), **packed})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("jaccard_join")
        reduce = SharedTokens()
        for batch in batches:
            for row in range(batch.num_rows):
                reduce.add([np.frombuffer(batch.column(i + 1)[row].as_py(), kind) for i, (_, kind) in enumerate(_POSTING)])
                if reduce.waiting >= POSTINGS_AT_ONCE:
                    yield reduce.emit()
        yield reduce.emit()

    dealt = rows.mapInArrow(deal, "bucket long, token binary, set binary, n binary, at binary").repartition("bucket")
    found = dealt.mapInArrow(gather, "token long, set long, n int, at int").dropDuplicates(["token", "set"])
    nth = F.row_number().over(Window.partitionBy("set").orderBy(rule.short().desc(), F.desc("at"), "token"))
    return tables.put("postings", found.join(nodes.drop("doc_id", "n", "wide"), "set").withColumn("nth", nth))


class SharedTokens:
    """Postings in, postings of tokens that two sets hold out. Keeps one posting of each token that it has met."""

    def __init__(self):
        self.known = [np.zeros(0, kind) for _, kind in _POSTING]
        self.emitted = np.zeros(0, bool)
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.new.append(columns)
        self.waiting += len(columns[0])

    def emit(self) -> pa.RecordBatch:
        """The postings taken in since the last call, and the kept ones of tokens that became shared by them."""
        token, sets, n, at = (np.concatenate([old, *x]) for old, x in zip(self.known, zip(*self.new) if self.new else [()] * 4))
        out = np.zeros(len(token), bool)
        out[: len(self.emitted)] = self.emitted
        self.new, self.waiting = [], 0
        by = np.lexsort((sets, token))
        token, sets, n, at, out = token[by], sets[by], n[by], at[by], out[by]
        first = np.append(True, token[1:] != token[:-1])[: len(token)]
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        other = np.append(False, (sets[1:] != sets[:-1]) & ~first[1:])[: len(token)]
        both = np.zeros(len(starts), bool)
        both[group[other | out]] = True
        give = both[group] & ~out
        batch = pa.RecordBatch.from_pydict({"token": signed(token[give]), "set": sets[give], "n": n[give], "at": at[give]})
        self.known, self.emitted = [x[starts] for x in (token, sets, n, at)], both
        return batch


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if they are at most ``BROADCAST_NODES``."""
    return F.broadcast(ids) if ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else ids


def _held(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Rule, shared, tables: StageTables) -> DataFrame:
    """(set, b, c, shingles) of every end of the pairs, from the text of one of its rows.

    Values under orders B and C are cut to 32 bits: an overlap is never missed, and a false one only costs a verification.
    """
    ends = tables.put("ends", pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct())
    one = tables.put("one", nodes.join(_few(ends), "set", "left_semi").select("set", "doc_id"))
    texts = rows.join(_few(one), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("jaccard_join")
        marks, seen = np.frombuffer(shared.value, np.uint64), set()
        for keys, texts in text_batches(batches, "set", "text", 1_000_000):
            out: dict[str, list] = {x: [] for x in ("set", "b", "c", "shingles")}
            for key, t in zip(keys.to_pylist(), texts):
                s = shingles(t, rule.k)
                if key in seen or not len(s) or set_hash(s) != key:  # another row of the same id
                    continue
                seen.add(key)
                n = rule.prefix(len(s))
                values = (key, *(ordered(s, marks, n, x).astype(np.uint32).view(np.int32) for x in (_B, _C)), signed(s))
                for column, value in zip(out.values(), values):
                    column.append(value)
            types = [pa.int64()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_pydict({x: pa.array(v, t) for (x, v), t in zip(out.items(), types)})

    held = tables.put("held", texts.select("set", "text").mapInArrow(run, "set long, b array<int>, c array<int>, shingles array<long>"), codec="lz4")
    for t in ("ends", "one"):
        tables.drop(t)
    return held


def _salted(left: DataFrame, right: DataFrame, hot: DataFrame, spread_by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: hot tokens of the left are spread over ``SALTS`` salts, those of the right copied to each."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    one = left.join(F.broadcast(hot), "token", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one, right.join(F.broadcast(hot), "token", "left").withColumn("salt", F.explode(salts)).drop("hot")


def _hot(tokens: DataFrame) -> DataFrame:
    """Tokens with over 1/``HOT_SHARE`` of all postings, ``HOT_SHARE`` at most, so their list can be broadcast."""
    total = tokens.agg(F.sum("times")).first()[0] or 0
    return tokens.where(F.col("times") > max(1000, total // HOT_SHARE)).select("token", F.lit(True).alias("hot"))


_OTHER = {"set": "other", "n": "m", "at": "other_at", "label": "other_label", **{f"s{i}": f"t{i}" for i in range(4)}}


def _link(rows: DataFrame, nodes: DataFrame, postings: DataFrame, rule: Rule, shared, tables: StageTables) -> DataFrame:
    """(id, label): the component of every set that has a link."""
    spark = postings.sparkSession
    labels = spark.range(0).withColumn("label", F.col("id"))
    for turn in range(PIVOT_TURNS + 1):
        last = turn == PIVOT_TURNS
        current = postings if last else postings.where(F.col("nth") <= PIVOT_TOKENS)
        current = current.drop("nth").join(_few(labels), F.col("set") == F.col("id"), "left").withColumn("label", F.coalesce("label", "set")).drop("id")
        pivot = F.min(F.struct(F.xxhash64("set", F.lit(turn)).alias("h"), *_OTHER)).alias("pivot")
        apart = current.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times"), *([] if last else [pivot])).where("low <> high")
        apart = tables.put(f"apart{turn}", apart.drop("low", "high"))
        if apart.isEmpty():
            continue
        hot = _hot(apart)
        if last:
            left, right = _all_apart(_with_first(current, postings), apart, hot, rule)
        else:
            left, right = _salted(current, apart.select("token", *(F.col(f"pivot.{a}").alias(b) for a, b in _OTHER.items())), hot, "set")
        both = _candidates(left, right, rule, last)
        pairs = tables.put(f"pairs{turn}", both.select(F.least("set", "other").alias("x"), F.greatest("set", "other").alias("y")).distinct())
        pairs = tables.put(f"alike{turn}", _alike(pairs, nodes, rule))
        held = _held(rows, nodes, pairs, rule, shared, tables)
        labels = tables.put(f"labels{turn}", _relabelled(labels, verify(pairs, held, rule), turn, tables))
        for t in (f"apart{turn}", f"pairs{turn}", f"alike{turn}", "held", f"labels{turn - 1}"):
            tables.drop(t)
    return tables.put("labels", labels)


def _relabelled(labels: DataFrame, links: DataFrame, turn: int, tables: StageTables) -> DataFrame:
    """(id, label) after the links: components of the graph whose nodes are the labels so far."""
    known = _few(labels)
    ends = tables.put(f"links{turn}", links)
    for end in ("x", "y"):
        ends = ends.join(known.toDF(end, f"l{end}"), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    edges = ends.select(F.col("lx").alias("x"), F.col("ly").alias("y")).where("x <> y").distinct()
    merged = connected(edges, tables, f"turn{turn}-")
    old = labels.join(_few(merged).toDF("label", "new"), "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    met = merged.join(labels.select("id"), "id", "left_anti")
    return old.unionByName(met)


def _with_first(current: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings with ``first``: those of their set's ``FIRST_TOKENS`` first shared tokens that come before them."""
    place = F.row_number().over(Window.partitionBy("set").orderBy("at"))
    each = postings.select("set", "at", "token").withColumn("place", place).where(F.col("place") <= FIRST_TOKENS).groupBy("set").agg(F.collect_list(F.struct("at", "token")).alias("all"))
    before = F.transform(F.filter("all", lambda x: x["at"] < F.col("at")), lambda x: x["token"])
    return current.join(each, "set").withColumn("first", before).drop("all")


def _candidates(left: DataFrame, right: DataFrame, rule: Rule, last: bool) -> DataFrame:
    """The join of both sides. In the last round the right set is the smaller, and the pair does not meet under an earlier token.

    The filters hold under an earlier token of both sets if they hold under a later one, so under one of them it is emitted.
    """
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("label") != F.col("other_label")) & rule.near("n", "m", "at", "other_at") & rule.alike("n", "m")
    if last:
        smaller = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("other") < F.col("set"))
        on = on & smaller & ~F.arrays_overlap("first", "other_first")
    return left.alias("l").join(right.alias("r"), on)


def _all_apart(current: DataFrame, apart: DataFrame, hot: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Both sides of the last round: all postings of tokens whose sets lie in different components, salted alike.

    The right side holds the smaller set of a pair, which shares a token with any linked set within a shorter prefix.
    """
    left, tokens = _salted(current, apart.select("token"), hot, "set")
    left = left.join(tokens, ["token", "salt"], "left_semi")
    _, right = _salted(apart, current.where(rule.short()), hot, "token")
    return left, right.select("token", "salt", *(F.col(a).alias(b) for a, b in _OTHER.items()), F.col("first").alias("other_first"))


def _alike(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs less those of large sets, for which 256 bits say little, whose wide sketches differ too much."""
    wide = nodes.where("wide is not null").select("set", "n", "wide")
    both = pairs.join(wide.toDF("x", "nx", "wx"), "x", "left").join(wide.toDF("y", "ny", "wy"), "y", "left")
    bits = F.aggregate(F.zip_with("wx", "wy", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return both.where(F.col("wx").isNull() | F.col("wy").isNull() | (bits * (rule.num + rule.den) <= (F.col("nx") + F.col("ny")) * (rule.den - rule.num))).select("x", "y")


def verify(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) that share a prefix value under order B and one under C, and link by their exact intersection.

    The orders are asked first, with the prefixes alone; whole sets are joined to the pairs that pass.
    """
    side = lambda x, *columns: held.select(F.col("set").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in columns))
    near = agreeing(pairs.join(side("x", "b", "c"), "x").join(side("y", "b", "c"), "y")).select("x", "y")
    both = near.join(side("x", "shingles"), "x").join(side("y", "shingles"), "y")
    common = F.size(F.array_intersect("sx", "sy")).cast("long")
    return both.where(common * (rule.num + rule.den) >= (F.size("sx") + F.size("sy")).cast("long") * rule.num).select("x", "y").distinct()


def agreeing(pairs: DataFrame) -> DataFrame:
    """The pairs whose prefixes share a value under both orders."""
    return pairs.where(F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy"))


def connected(links: DataFrame, tables: StageTables, name: str) -> DataFrame:
    """(id, label): the smallest id of each link's component, by minimum labels with pointer jumping."""
    edges = tables.put(f"{name}edges", links.select("x", "y").union(links.select("y", "x")).distinct())
    labels = tables.put(f"{name}labels0", edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    step = 0
    while True:
        step += 1
        near = edges.join(labels, edges["y"] == labels["id"]).groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("mid"), F.col("label").alias("was"))
        to = labels.select(F.col("id").alias("mid"), F.col("label").alias("jump"))
        new = tables.put(f"{name}labels{step}", lower.join(to, "mid").select("id", F.least("mid", "jump").alias("label"), "was"))
        done = new.where("label <> was").isEmpty()
        tables.drop(f"{name}labels{step - 1}")
        labels = new.select("id", "label")
        if done:
            tables.drop(f"{name}edges")
            return labels
