"""Benchmark decontamination: BM25 over an inverted index of test items, searched block by block under maximum scores.

Index: terms are white-space pieces, lower-cased, without characters that are neither letters nor digits. Every item has
BM25 impacts for its distinct terms; items are sorted by threshold and cut into blocks; each term keeps its largest impact
in every block and overall. Items are dealt by a hash into shards of about ``SHARD_ITEMS``; each shard is one index, sent
to the workers and searched in a pass of its own, so any number of items is searched and the size of an index is bounded.

Search (no shuffle of texts): a text is cut into passages of ``2 * longest`` terms that start every ``longest`` terms, where
``longest`` is the most terms of an item and of what may be put into it; each passage is a query, and so is the text as a
whole if it has several, since a copy can be spread over passages by what stands in between. As in block-max WAND a query
is dropped when the sum of its terms' overall maxima stays under the lowest threshold, then a block when the sum of block
maxima stays under the block's lowest threshold; only items of the blocks left are scored exactly, and every item above
its own threshold is retrieved. An item's threshold is its score against itself less the largest share that a text keeping
``min_overlap`` of its 5-word shingles may lose, so no text that does is missed.

Verification: the item's shingles of five words (fewer words: the whole item) are looked up in the whole text. Its last
sentence, or last quarter where that has under five words, is the answer, the rest the question. A match needs
``min_overlap`` of all shingles; the shares of the question's and of the answer's own are given beside it and decide
nothing, since one changed word can remove most shingles of a short answer. Reported are the score and first term of the
best passage (ties: the first), or, if no passage alone reaches the threshold, those of the whole text.

Null or empty text matches nothing; so does an item without terms. An item without id matches like any other and is
reported with a null id. Items with equal text match alike, each by its id; an item that repeats with id and text counts
once. Repeated rows match each. Very long texts are searched whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_type, filter_rows, text_batches, two_columns, worker_state

SHARD_ITEMS = 10_000
BLOCK = 4
MAX_BLOCKS = 256
SHINGLE = 5
K1, B = 1.2, 0.75
#: Numbers held at once in sums over blocks, and postings looked up at once.
SUMS_AT_ONCE, LOOKUPS_AT_ONCE = 2_000_000, 200_000
CACHE_KEYS = 100_000
_SENTENCE = re.compile(r"[.!?]\s+")


def term(piece: str) -> str:
    piece = piece.lower()
    return piece if piece.isalnum() else "".join(c for c in piece if c.isalnum())


@dataclass
class Item:
    key: int
    terms: np.ndarray
    #: Terms before this one belong to the question.
    split: int
    threshold: float = 0.0
    #: Shingles that a match needs.
    need: int = 0
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], min_overlap: float):
        self.min_overlap = min_overlap
        self.ids: dict[str, int] = {}
        self.longest = 1
        found = []
        for key, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "") if not isinstance(x[0], str) else (False, x[0], x[1] or "")):
            pieces = [term(p) for p in (text or "").split()]
            words = [p for p in pieces if p]
            if words:
                cuts = [m.end() for m in _SENTENCE.finditer(text.strip())]
                tail = len([p for p in text.strip()[cuts[-1] :].split() if term(p)]) if cuts else 0
                if not SHINGLE <= tail <= len(words) - SHINGLE:
                    tail = max(1, len(words) // 4)
                found.append(Item(key, np.array([self.ids.setdefault(w, len(self.ids)) for w in words]), len(words) - tail))
        df = np.zeros(len(self.ids) + 1)
        for i in found:
            df[np.unique(i.terms)] += 1
        idf = np.log(1 + (len(found) - df + 0.5) / (df + 0.5))
        mean = np.mean([len(i.terms) for i in found]) if found else 1.0
        impacts = []
        for i in found:
            at, tf = np.unique(i.terms, return_counts=True)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(i.terms) / mean))
            width = min(SHINGLE, len(i.terms))
            grams = np.lib.stride_tricks.sliding_window_view(i.terms, width)
            for n, g in enumerate(map(tuple, grams.tolist())):
                (i.question if n < i.split else i.answer).add(g)
            every = len(i.question | i.answer)
            i.need = math.ceil(Fraction(str(min_overlap)) * every)
            lost = every - i.need
            self.longest = max(self.longest, len(i.terms) + lost)
            i.threshold = float(w.sum() - np.sort(w)[::-1][:lost].sum()) - 1e-9
            impacts.append((at, w))
        order = sorted(range(len(found)), key=lambda n: found[n].threshold)
        self.items = [found[n] for n in order]
        self.thresholds = np.array([i.threshold for i in self.items])
        self.block = max(BLOCK, -(-len(self.items) // MAX_BLOCKS))
        blocks = -(-len(self.items) // self.block)
        self.n_terms = len(self.ids) + 1
        self.block_max = np.zeros((self.n_terms, blocks), np.float32)
        self.block_low = self.thresholds[:: self.block]
        keys, nth, weight = [], [], []
        for n, o in enumerate(order):
            at, w = impacts[o]
            np.maximum.at(self.block_max[:, n // self.block], at, (w * 1.000001).astype(np.float32))
            keys.append(n // self.block * self.n_terms + at)
            nth.append(np.full(len(at), n))
            weight.append(w)
        keys, nth, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nth, weight))
        by = np.argsort(keys, kind="stable")
        #: Postings in the order of (block, term).
        self.keys, self.nth, self.weight = keys[by], nth[by], weight[by]
        self.term_max = self.block_max.max(axis=1, initial=0.0)
        self.cache: dict[str, int] = {}
        #: By width, the hashes of all items' shingles.
        grams = {g for i in self.items for g in i.question | i.answer}
        self.grams = {w: np.unique(_hashed(np.array([g for g in grams if len(g) == w], np.int64))) for w in sorted({len(g) for g in grams})}

    def terms_of(self, text: str) -> np.ndarray:
        """Term numbers of the whole text; a word that no item has is -1."""
        pieces = text.split()
        new = [p for p in set(pieces) if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_KEYS:
            self.cache, new = {}, list(set(pieces))
        for p in new:
            w = term(p)
            self.cache[p] = self.ids.get(w, -1) if w else -2
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        return at[at != -2]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first term of the passage, score, question's overlap, answer's overlap), an item's best passage."""
        best: dict[tuple[int, int], tuple] = {}
        if not self.items or not texts:
            return []
        terms = [self.terms_of(t) for t in texts]
        sizes = np.array([len(t) for t in terms])
        step = self.longest
        counts = np.maximum(1, -(-sizes // step) - 1)
        whole = counts > 1
        first = np.cumsum(counts + whole) - counts - whole
        word = np.concatenate(terms)
        doc = np.repeat(np.arange(len(texts)), sizes)
        slot = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // step
        # a term lies in the passage that starts in its slot, in the one before, and in the whole text
        known = word >= 0
        word, doc, slot = word[known], doc[known], slot[known]
        pairs = np.concatenate([*((first[doc] + x)[ok] * self.n_terms + word[ok] for x in (slot, slot - 1) for ok in ((x >= 0) & (x < counts[doc]),)), ((first + counts)[doc] * self.n_terms + word)[whole[doc]]])
        pairs = np.unique(pairs)
        if not len(pairs):
            return []
        passage, term_no = pairs // self.n_terms, pairs % self.n_terms
        passage, term_no = self._reach(passage, term_no, self.term_max[:, None], self.thresholds[:1])[:2]
        passage, term_no, number, block = self._reach(passage, term_no, self.block_max, self.block_low)
        for p, n, score in self._scores(passage, term_no, number, block):
            d = int(np.searchsorted(first, p, "right")) - 1
            part = p - int(first[d])
            row = (part < counts[d], score, -part)
            if (d, n) not in best or row > best[d, n]:
                best[d, n] = row
        out, have, last = [], set(), -1
        for d, n in sorted(best):
            if d != last:
                have, last = self._shingles(terms[d]), d
            found = self._verify(n, have)
            if found:
                alone, score, part = best[d, n]
                out.append((d, self.items[n].key, -part * step if alone else 0, score, *found))
        return out

    def _reach(self, passage: np.ndarray, term_no: np.ndarray, most: np.ndarray, low: np.ndarray):
        """The passages whose summed maxima reach the threshold of any column; then (row, column) of each sum that does."""
        none = np.zeros(0, np.int64)
        if not len(passage):
            return none, none, none, none
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(passage))
        reach, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SUMS_AT_ONCE // most.shape[1], "right")))
            reach.append(np.add.reduceat(most[term_no[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0) >= low)
            i = j
        reach = np.concatenate(reach)
        keep = reach.any(axis=1)
        rows, columns = np.nonzero(reach[keep])
        kept = np.repeat(keep, ends - starts)
        return passage[kept], term_no[kept], rows, columns

    def _scores(self, passage: np.ndarray, term_no: np.ndarray, rows: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, exact score) where the score reaches the item's threshold, of the given rows and blocks."""
        out = []
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else rows
        sizes = np.diff(np.append(starts, len(passage)))
        ends, i = np.cumsum(sizes[rows]), 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LOOKUPS_AT_ONCE, "right")))
            r, b = rows[i:j], blocks[i:j]
            i = j
            n = sizes[r]
            at = np.repeat(starts[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.repeat(b * self.n_terms, n) + term_no[at]
            low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            m = high - low
            post = np.repeat(low, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            pair = np.repeat(np.repeat(np.arange(len(r)), n), m)
            score = np.bincount(pair * self.block + self.nth[post] - np.repeat(np.repeat(b * self.block, n), m), self.weight[post], len(r) * self.block).reshape(len(r), -1)
            limit = np.append(self.thresholds, np.full(self.block, np.inf))[b[:, None] * self.block + np.arange(self.block)]
            out += [(int(passage[starts[r[x]]]), int(b[x] * self.block + y), float(score[x, y])) for x, y in zip(*np.nonzero(score >= limit))]
        return out

    def _shingles(self, terms: np.ndarray) -> set:
        """Those of the text's shingles that may be an item's."""
        have = set()
        for width, hashes in self.grams.items():
            if len(terms) >= width:
                windows = np.lib.stride_tricks.sliding_window_view(terms, width)
                have.update(map(tuple, windows[np.isin(_hashed(windows), hashes)].tolist()))
        return have

    def _verify(self, n: int, have: set) -> tuple[float, float] | None:
        item = self.items[n]
        q, a = len(item.question & have) / max(1, len(item.question)), len(item.answer & have) / max(1, len(item.answer))
        return (q, a) if len((item.question | item.answer) & have) >= item.need else None


def _hashed(windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), np.uint64)
    for i in range(windows.shape[1] if windows.ndim == 2 else 0):
        out = (out ^ windows[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _shards(items: DataFrame, item_id: str, item_text: str, min_overlap: float) -> Iterator[tuple[str, object]]:
    """For each shard a name for the workers' cache and the broadcast items."""
    spark = items.sparkSession
    rows = two_columns(items, item_id, item_text).distinct()
    shards = -(-rows.count() // SHARD_ITEMS)
    for i in range(shards):
        found = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)) == i).collect()
        yield f"decontam {uuid.uuid4().hex}", spark.sparkContext.broadcast(([(r.doc_id, r.text) for r in found], min_overlap))


def find_contamination(docs: DataFrame, items: DataFrame, min_overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, passage_start, bm25, question_overlap, answer_overlap): one row for each text and item that match."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = two_columns(docs, id_col, text_col)
    types = pa.schema(list(zip(_COLUMNS, (arrow_type(kind), arrow_type(item_kind), pa.int64(), pa.float64(), pa.float64(), pa.float64()))))
    columns = f"doc_id {kind}, item_id {item_kind}, passage_start long, bm25 double, question_overlap double, answer_overlap double"

    def search(name: str, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = worker_state(name, lambda: ItemIndex(*shared.value))
            for ids, texts in text_batches(batches, "doc_id", "text", 1_000_000):
                found = [(ids[row[0]].as_py(), *row[1:]) for row in index.search(texts)]
                yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, f)) for f in found], schema=types)

        return rows.mapInArrow(run, columns)

    found = [search(*shard) for shard in _shards(items, item_id, item_text, min_overlap)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], columns)


def uncontaminated(docs: DataFrame, items: DataFrame, min_overlap: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, whole, that match no item."""

    def clean(name: str, shared) -> Callable[[list[str]], list[bool]]:
        held: list[ItemIndex] = []

        def keep(texts: list[str]) -> list[bool]:
            if not held:
                held.append(worker_state(name, lambda: ItemIndex(*shared.value)))
            found = {row[0] for row in held[0].search(texts)}
            return [n not in found for n in range(len(texts))]

        return keep

    for name, shared in _shards(items, item_id, item_text, min_overlap):
        docs = filter_rows(docs, clean(name, shared), text_col)
    return docs


_COLUMNS = ("doc_id", "item_id", "passage_start", "bm25", "question_overlap", "answer_overlap")
