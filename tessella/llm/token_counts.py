"""Token counts by a two-tier map-side lookup of pre-token lengths; nothing is shuffled.

Tier one: a broadcast table of at most ``table_size`` pre-tokens and their lengths (a text of joined keys and an array of
16-bit lengths; about ten bytes an entry). It holds first the pre-tokens that are frequent in a bounded sample of the texts
(``SAMPLE_ROWS`` texts that Spark takes from the first partitions, ``SAMPLE_CHARS`` characters of each, so 8 MB at most),
of one token or many; then, up to its size, those that are entries of the tokenizer's vocabulary, in the order of its merges.
Their lengths are worked out once on the driver by the tokenizers library. The table decides only which tier answers, never
the count; every text is counted whole, and no pass over the corpus is spent on the table.

Tier two: what the table lacks is encoded by the library in the worker, once per worker while its cache of at most
``CACHE_KEYS`` keys holds it. ``with_tiers`` tells how many pre-tokens each text has and how many tier one answered.

A pre-token is a chunk (see ``chunks``), which the tokenizer's pattern never splits across. Strings of special tokens
inside a text are one token each, as the library has it by default, and split the text.

Null and empty texts count 0 bytes and 0 tokens. There are no ties. Very long texts are counted whole, one to a batch. Repeated rows are
counted each; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.chunks import chunk_keys, chunk_text
from tessella.llm.common import text_batches, two_columns, worker_state

CACHE_KEYS = 1_500_000
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 8000
#: No key contains it: chunks of even texts hold no tabs, others start with a carriage return.
_SEPARATOR = "\x00\t\x00"


class Lengths:
    """Numbers of tokens of chunks and texts for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["post_processor"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer is counted by chunks")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters aren't supported")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.library = Tokenizer.from_file(path)
        self.frequent: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.version = None

    def of(self, keys: list[str]) -> list[int]:
        # Special strings are cut out beforehand, but a chunk alone may still look like one after "\r" is taken off.
        return [len(e.ids) for e in self.library.encode_batch([chunk_text(k) for k in keys], add_special_tokens=False)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        parts, found = [text], 0
        for s in self.special:
            if s in text:
                cut = [p.split(s) for p in parts]
                found += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        return parts, found

    def load(self, version: str, table: tuple[str, bytes]) -> None:
        if self.version != version:
            keys, sizes = table
            self.frequent = dict(zip(keys.split(_SEPARATOR), np.frombuffer(sizes, "<u2").tolist())) if sizes else {}
            self.version, self.cache = version, {}

    def tiers(self, texts: list[str]) -> list[tuple[int, int]]:
        """Of every text the number of its pre-tokens and of those that the table holds."""
        keys = [[k for p in self.parts(t)[0] for k in chunk_keys(p)] for t in texts]
        return [(len(ks), sum(k in self.frequent for k in ks)) for ks in keys]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) for t in texts]
        keys = [[k for p in parts for k in chunk_keys(p)] if found else chunk_keys(parts[0]) for parts, found in split]
        new = {x for k in keys for x in k if x not in self.frequent}
        if len(self.cache) + len(new) > CACHE_KEYS:
            self.cache = {}
        todo = [k for k in new if k not in self.cache]
        self.cache.update(zip(todo, self.of(todo)))
        first, second = self.frequent.get, self.cache.get
        return [found + sum(first(k) or second(k, 0) for k in ks) for ks, (_, found) in zip(keys, split)]


def worker(path: str) -> Lengths:
    return worker_state(f"token_counts {path}", lambda: Lengths(path))


def frequent_pre_tokens(path: str, sample: list[str] = [], table_size: int = 65_536) -> list[str]:  # noqa: B006
    """Keys of pre-tokens: those that the sample holds more than once, the commonest first, then vocabulary entries."""
    held = Lengths(path)
    times = Counter(k for t in sample for p in held.parts(t)[0] for k in chunk_keys(p))
    common = sorted((k for k, n in times.items() if n > 1), key=lambda k: (-times[k], k))
    entries = [held.library.decode([i]) for i in sorted(held.library.get_vocab().values())]
    whole = [t for t in dict.fromkeys(entries) if t and "\ufffd" not in t]
    after_blank = [t[1:] for t in whole if t[0] == " " and t[1:] and not t[1:].isspace() and len(t[1:].split()) == 1 and t[1:].strip() == t[1:]]
    return [k for k in dict.fromkeys([*common, *after_blank, *("\r" + t for t in whole)]) if _SEPARATOR not in k][:table_size]


def count_tokens(docs: DataFrame, path: str, table_size: int = 65_536, id_col: str = "doc_id", text_col: str = "text", with_tiers: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text; with tiers also (n_lookups, n_first)."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = two_columns(docs, id_col, text_col)
    sample = [r[0] for r in rows.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS)).take(SAMPLE_ROWS)]
    keys = frequent_pre_tokens(path, sample, table_size)
    sizes = Lengths(path).of(keys)
    fits = [(k, n) for k, n in zip(keys, sizes) if 0 < n < 65536]
    table = (_SEPARATOR.join(k for k, _ in fits), np.array([n for _, n in fits], "<u2").tobytes())
    shared = spark.sparkContext.broadcast(table)
    version = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker(path)
        held.load(version, shared.value)
        for ids, texts in text_batches(batches, "doc_id", "text"):
            out = {"doc_id": ids, "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(held.count(texts), pa.int64())}
            if with_tiers:
                found = held.tiers(texts)
                out |= {name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(("n_lookups", "n_first"))}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", n_lookups long, n_first long" * with_tiers)
