"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

1. Every text is encoded by the tokenizers library, ``end_id`` is appended, and the ids are staged in the shared folder.
   Pieces between white space are encoded once and cached: the tokenizer never joins across it. A piece with characters
   beyond ASCII and the accented Latin letters up to U+017E (composed, each with one lower case, letters in every version
   of Unicode) goes to the library as it stands, so its normalisation, lower case and pre-tokens are the library's own.
2. Ids are counted over all staged documents (a bincount to a task, then a sum to an id) and ranked: the most frequent id
   gets code 0. The ranking has one entry to an id of the vocabulary, so its size is known.
3. Each document's codes are written with 1 to 4 bytes each: two bits a code in the control bytes (four codes to a byte),
   the values' bytes apart from them. Documents are dealt into ranges of ascending doc_id and written as files of blocks;
   a block holds up to ``BLOCK_IDS`` ids (a longer document has a block of its own) with its documents' ids and counts.
   The folder also holds ``ranks`` (code, id) and ``starts`` (the number of ids before each file's first block).
4. Reading expands control bytes by a table of 256 x 4 lengths and gathers the values with numpy.

The files are Parquet so that any store Spark writes to can hold them. Only ids are shuffled, never texts.

Null and empty texts hold only the end id. Rows that repeat a doc_id are an entry each, in the order of their ids; rows
without doc_id come first. Very long texts are encoded whole and fill a block of their own. Empty tables give empty files.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import StageTables, arrow_type, text_batches, two_columns, worker_state

BLOCK_IDS = 1 << 18
#: Ids of one file at most, about, when the cluster's cores have a file each.
FILE_IDS = 1 << 25
CACHE_KEYS = 1_000_000

#: Visible ASCII, and accented Latin letters without the dotted capital I.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+")
_PLAIN_TEXT = re.compile(r"(?s:[\s!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+)")

# ---- coding -----------------------------------------------------------------------------------------------------------
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit codes."""
    codes = codes.astype("<u4")
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    quads = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    quads[: len(codes)] = extra
    control = quads[0::4] | quads[1::4] << 2 | quads[2::4] << 4 | quads[3::4] << 6
    ends = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(codes) + 1)
    data, at = np.empty(int(ends[-1]) if len(codes) else 0, np.uint8), ends - extra - 1
    data[at] = codes & 0xFF
    for k in range(1, int(extra.max(initial=0)) + 1):
        longer = np.flatnonzero(extra >= k)
        data[at[longer] + k] = codes[longer] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` codes that ``pack`` was given."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    values, at = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes
    out = values[at].astype("<u4")
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= values[at[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


# ---- encoding ---------------------------------------------------------------------------------------------------------
class WordEncoder:
    """Encodes texts by the library; pieces between white space are cached, since the tokenizer never joins across it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        #: White space is dropped and normalisation is NFC and lower case: only then do pieces stand alone.
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("behavior") == "Removed" and bool(splits[0].get("invert"))
        self.size = self.library.get_vocab_size()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.by_piece = self.by_piece and bool(suffix)
        #: Ids of tokens that end a pre-token.
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.pre_token = regex.compile(splits[0]["pattern"]["Regex"]) if self.by_piece else None
        #: Whether a run of letters alone is one pre-token.
        self.letters_whole = self.by_piece and "[\\p{L}]+" in splits[0]["pattern"]["Regex"]
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Caches the ids of pieces. Pre-tokens of plain pieces are encoded many at a time, each up to its end token."""
        other = [p for p in pieces if not p.isascii() and not _PLAIN.fullmatch(p)]
        self.cache.update(zip(other, self._library(other)))
        pieces = [p for p in pieces if p not in self.cache] if other else pieces
        findall = self.pre_token.findall
        cut = [[p] if self.letters_whole and p.isalpha() else findall(p) for p in map(str.lower, pieces)]
        new = {w for words in cut for w in words}.difference(self.words)  # looks up the new ones, does not walk the cache
        if len(self.words) + len(new) > CACHE_KEYS:
            self.words = dict(islice(self.words.items(), CACHE_KEYS // 2))  # what is frequent is met early
            new = {w for words in cut for w in words if w not in self.words}
        todo = list(new)
        for start in range(0, len(todo), 1000):
            part = todo[start : start + 1000]
            flat = self._library([" ".join(part)])[0]
            ends = (np.flatnonzero(self.ends[np.frombuffer(flat, "<u4")]) * 4 + 4).tolist()
            if len(ends) == len(part):
                self.words.update((w, flat[a:b]) for w, a, b in zip(part, [0, *ends], ends))
            else:  # a character without a token of its own: each by itself
                self.words.update(zip(part, self._library(part)))
        get = self.words.__getitem__
        self.cache.update((p, get(words[0]) if len(words) == 1 else b"".join(map(get, words))) for p, words in zip(pieces, cut))

    def _pieces(self, text: str) -> list[str] | None:
        # Python's white space has four separators, U+001C to U+001F, that the tokenizer's pattern has not
        if not self.by_piece or any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        if text.isascii() or _PLAIN_TEXT.fullmatch(text):
            return text.lower().split()  # one form for all cases of a piece
        return [p.lower() if p.isascii() else p for p in text.split()]

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        new: set[str] = set()
        for p in pieces:
            new.update(p or ())
        new = new.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_KEYS:
            self.cache = dict(islice(self.cache.items(), CACHE_KEYS // 2))
            new = {x for p in pieces for x in p or () if x not in self.cache}
        self._learn(list(new))
        get = self.cache.__getitem__
        return [self._library([t])[0] if p is None else b"".join(map(get, p)) for t, p in zip(texts, pieces)]


def worker(path: str) -> WordEncoder:
    return worker_state(f"token_files {path}", lambda: WordEncoder(path))


# ---- writing ----------------------------------------------------------------------------------------------------------
def stage_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): 16-bit ids where the vocabulary fits in them, else 32-bit, with ``end_id`` at the end."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker(path)
        width = "<u2" if max(held.size, end_id + 1) <= 65536 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for keys, texts in text_batches(batches, "doc_id", "text"):
            ids = [np.frombuffer(x + end, "<u4") for x in held.encode(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype(width).tobytes() for x in ids], pa.binary())})

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, ids binary")


def count_ids(staged: DataFrame) -> DataFrame:
    """(id, n) over all staged documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(np.frombuffer(raw, f"<u{len(raw) // n}"))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return staged.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK = "file_no int, block_no long, before long, n_ids long, doc_ids array<{kind}>, counts array<long>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> str:
    """Writes the token files of ``docs`` to the folder ``out`` and returns it."""
    spark: SparkSession = docs.sparkSession
    tables = StageTables(spark, "ids")
    kind = docs.schema[id_col].dataType.simpleString()
    staged = tables.put("staged", stage_ids(docs, path, end_id, id_col, text_col))
    counts = sorted(((r.n, r.id) for r in count_ids(staged).collect()), key=lambda x: (-x[0], x[1]))
    order = np.array([i for _, i in counts], np.int64)
    code_of = np.zeros(int(order.max(initial=0)) + 1, "<u4")
    code_of[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(code_of.tobytes())
    spark.createDataFrame([(c, int(i)) for c, i in enumerate(order.tolist())], "code long, id long").coalesce(1).write.parquet(f"{out}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before, table = TaskContext.get().partitionId(), 0, 0, np.frombuffer(shared.value, "<u4")
        keys: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            control, data = pack(table[np.concatenate(held)])
            return pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int32()), "block_no": pa.array([block], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([total], pa.int64()), "doc_ids": pa.array([keys], pa.list_(arrow_type(kind))), "counts": pa.array([sizes], pa.list_(pa.int64())), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for key, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if keys and total + n > BLOCK_IDS:
                    yield close()
                    before += total
                    keys, sizes, held, total, block = [], [], [], 0, block + 1
                total += n
                keys.append(key)
                sizes.append(n)
                held.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
        if keys:
            yield close()

    ids = sum(n for n, _ in counts)
    n_files = files or max(1, -(-ids // FILE_IDS), min(spark.sparkContext.defaultParallelism, -(-ids // BLOCK_IDS)))
    ranged = staged.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(blocks, _BLOCK.format(kind=kind)).write.option("compression", "zstd").parquet(f"{out}/blocks")
    totals = sorted((r.file_no, r.n) for r in spark.read.schema(_BLOCK.format(kind=kind)).parquet(f"{out}/blocks").groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect())
    starts, before = [], 0
    for file_no, n in totals:
        starts.append((file_no, before))
        before += n
    spark.createDataFrame(starts, "file_no int, start long").coalesce(1).write.parquet(f"{out}/starts")
    tables.drop()
    return out


# ---- reading ----------------------------------------------------------------------------------------------------------
def read_token_files(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: each block holds the number before it in its file, and the
    files' own starts, one number to a file, are broadcast.
    """
    blocks = spark.read.parquet(f"{out}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ranks = np.array([r.id for r in spark.read.parquet(f"{out}/ranks").orderBy("code").collect()], "<u4")
    shared = spark.sparkContext.broadcast(ranks.tobytes())
    starts = spark.read.parquet(f"{out}/starts")
    placed = blocks.join(F.broadcast(starts), "file_no").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "counts", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "<u4")
        for batch in batches:
            for start, keys, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ends = np.cumsum(sizes)
                ids = table[unpack(control, data, int(ends[-1]))]
                each = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes)]
                cols = {"doc_id": pa.array(keys, arrow_type(kind)), "start": pa.array(start + ends - np.array(sizes), pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(each, pa.binary())} if with_ids else {}))

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
