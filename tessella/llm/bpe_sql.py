"""Byte-level BPE by recursive SQL, one DuckDB connection to a Python worker.

Encoding. Every byte of a pre-token starts as one row (word, position, token id), linked to the next row. A round of the
recursive query joins each row and its successor with the merge table, takes each word's leftmost pair of minimum rank,
gives that row the merged id and drops its successor; words without a mergeable pair leave, and the recursion ends when
none is left. A pair may merge when the joined bytes are in the vocabulary, and its rank is that token's id, as in the
tiktoken library.

Words over ``LONG_WORD`` bytes are cut into windows that overlap by half, and every window is a word of the query. Two
windows are joined at a token that both hold at the same place. That is exact: whatever the ranks, a sequence of tokens is
the encoding of its bytes if every two neighbours encode to themselves, and in the result all neighbours stand side by
side in one window's own encoding. Where two windows hold no token in common, the next one is begun at a token of the
first; if that doesn't help, the window grows.

Decoding. Rows (document, position, id) join the vocabulary and an ordered aggregation concatenates the bytes. Bytes are
held as the 256 code points U+0100 to U+01FF inside SQL, so that every byte string is valid text.

Each worker caches the ids of at most ``cache_keys`` chunks (see ``chunks``); when the cache is full, the half that was
learned last goes (what is frequent is met early). That costs time and changes nothing else. The rows of one query are
bounded: a recursion keeps all its rounds, so words are given to it until the squares of their lengths sum to
``MERGE_ROWS``; ids are decoded in pieces of ``PIECE_TOKENS``. No shuffle; a lost task is simply run again.

Null and empty texts give no ids and empty bytes. Rows that repeat are encoded each. Very long texts and words are encoded
whole, in windows and pieces. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.chunks import PRE_TOKEN, chunk_keys, chunk_text
from tessella.llm.common import text_batches, two_columns, worker_state

LONG_WORD = 64
#: Chunks that a worker caches: about 200 bytes each. Fewer take more time and change nothing else.
CACHE_KEYS = 800_000
#: Windows of a long word that are learned at a time.
WINDOWS = 50_000
#: Longest key of a chunk that is cached, in characters.
CACHE_CHARS = 256
#: Sum of the squared lengths of the words of one recursive query.
MERGE_ROWS = 2_000_000
#: Tokens decoded by one query, and by one group of its ordered aggregation.
DECODE_TOKENS, PIECE_TOKENS = 200_000, 100_000

_SHORT = """
WITH RECURSIVE s(round, w, pos, id, nid, npos) AS (
  SELECT 0, w, pos, id, nid, npos FROM start_rows
  UNION ALL (
  WITH best AS MATERIALIZED (
    SELECT s.w, min(m.merged * 1048576 + s.pos) AS key FROM s JOIN merges m ON m.pair = s.id * 65536 + s.nid GROUP BY s.w),
  hit AS MATERIALIZED (
    SELECT b.w, h.pos AS spot, b.key // 1048576 AS merged, g.pos AS gone, g.nid AS nid, g.npos AS npos
    FROM best b JOIN s h ON h.w = b.w AND h.pos = b.key % 1048576 JOIN s g ON g.w = b.w AND g.pos = h.npos)
  SELECT s.round + 1, s.w, s.pos,
         CASE WHEN s.pos = spot THEN merged ELSE s.id END,
         CASE WHEN s.pos = spot THEN hit.nid WHEN s.npos = spot THEN merged ELSE s.nid END,
         CASE WHEN s.pos = spot THEN hit.npos ELSE s.npos END
  FROM s JOIN hit ON hit.w = s.w WHERE s.pos <> gone)
)
SELECT s.w, s.id FROM s JOIN (SELECT w, max(round) AS round FROM s GROUP BY w) USING (w, round) ORDER BY s.w, s.pos
"""


def _windows(word: bytes, first: int, last: int) -> list[bytes]:
    return [word[i : i + LONG_WORD] for i in range(first, last, LONG_WORD // 2)]


#: Places in a word and ids.
Tokens = tuple[array, array]


def _replace(tokens: Tokens, n: int, more: Tokens, m: int) -> None:
    for old, new in zip(tokens, more):
        old[n:] = new[m:]


def _splice(tokens: Tokens, more: Tokens) -> bool:
    """Goes over from ``tokens`` to ``more`` at a token that both hold at the same place, if there is one."""
    n, m = len(tokens[0]) - 1, len(more[0]) - 1
    while n >= 0 and m >= 0:
        if tokens[0][n] == more[0][m] and tokens[1][n] == more[1][m]:
            _replace(tokens, n, more, m)
            return True
        n, m = (n - 1, m) if tokens[0][n] >= more[0][m] else (n, m - 1)
    return False


class SqlBpe:
    """Encoder and decoder of one vocabulary, held once by each Python worker."""

    def __init__(self, path: str, cache_keys: int = CACHE_KEYS):
        import duckdb

        self.cache_keys = cache_keys

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ids of 65536 and more don't fit the pair key")
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    merged.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.con.register("m", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m").fetchall()
        shown = ["".join(chr(256 + b) for b in token) for token in self.ranks]
        self.con.register("v", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "shown": pa.array(shown, pa.string())}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v").fetchall()
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.chunks: dict[str, bytes] = {}
        #: Ids of windows of long words.
        self.windows: dict[bytes, bytes] = {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        pos = np.arange(len(ids), dtype=np.int64) - np.repeat(ends - sizes, sizes)
        nid, npos, last = np.append(ids[1:], 0), pos + 1, np.zeros(len(ids), bool)
        last[ends - 1] = True
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int64), sizes), "pos": pos, "id": ids, "nid": pa.array(nid, mask=last), "npos": pa.array(npos, mask=last)})

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(words):
            stop, held = start, 0
            while stop < len(words) and (stop == start or held + len(words[stop]) ** 2 <= MERGE_ROWS):
                held += len(words[stop]) ** 2
                stop += 1
            self.con.register("start_rows", self._rows(words[start:stop]))
            got = self.con.sql(_SHORT).to_arrow_table()
            flat = got.column("id").to_numpy().astype("<u4").tobytes()
            cuts = (np.searchsorted(got.column("w").to_numpy(), np.arange(stop - start + 1)) * 4).tolist()
            out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            start = stop
        return out

    def _learn_windows(self, windows: Iterable[bytes]) -> None:
        if len(self.windows) > 2 * WINDOWS:
            self.windows.clear()
        todo = sorted({w for w in windows if w not in self.windows}, key=len)
        self.windows.update(zip(todo, self._merge(todo)))

    def _placed(self, window: bytes, start: int) -> Tokens:
        """The window's tokens, their places counted from ``start``."""
        if window not in self.windows:
            self._learn_windows([window])
        ids = array("I", self.windows[window])
        return array("q", accumulate((self.sizes[i] for i in ids[:-1]), initial=start)), ids

    def _long_word(self, word: bytes) -> bytes:
        step = LONG_WORD // 2
        tokens: Tokens = (array("q"), array("I"))
        for part in range(0, len(word), WINDOWS * step):  # learned many at a time, never more than the cache holds
            last = min(len(word), part + WINDOWS * step)
            self._learn_windows(_windows(word, part, last))
            for at in range(part, last, step):
                end = min(len(word), at + LONG_WORD)
                if not tokens[0]:
                    _replace(tokens, 0, self._placed(word[:end], 0), 0)
                elif tokens[0][-1] + self.sizes[tokens[1][-1]] < end and not _splice(tokens, self._placed(word[at:end], at)):
                    self._grow(word, tokens, end)
        return tokens[1].tobytes()

    def _grow(self, word: bytes, tokens: Tokens, end: int) -> None:
        """Extends ``tokens`` to ``end`` by windows that begin at one of their own tokens, each time further back."""
        back = 1
        while True:
            n = max(0, len(tokens[0]) - back)
            start = tokens[0][n]
            more = self._placed(word[start:end], start)
            if n == 0 or more[1][0] == tokens[1][n]:
                _replace(tokens, n, more, 0)
                return
            back *= 2

    def _ids_of_words(self, words: set[str]) -> dict[str, bytes]:
        found = {w: got for w in words if w[0] == " " and (got := self.chunks.get(w[1:])) is not None}  # a chunk that is one word
        todo = sorted(((w, w.encode()) for w in words if w not in found), key=lambda x: len(x[1]))  # those of a query end together
        cut = next((i for i, (_, b) in enumerate(todo) if len(b) > LONG_WORD), len(todo))
        found.update(zip((w for w, _ in todo[:cut]), self._merge([b for _, b in todo[:cut]])))
        self._learn_windows(islice(chain.from_iterable(_windows(b, 0, len(b)) for _, b in todo[cut:]), WINDOWS))
        found.update((w, self._long_word(b)) for w, b in todo[cut:])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        new: set[str] = set()
        keys = [chunk_keys(t) for t in texts]
        for k in keys:
            new.update(k)
        new.difference_update(self.chunks)
        if len(self.chunks) + len(new) > self.cache_keys:
            self.chunks = dict(islice(self.chunks.items(), self.cache_keys // 2))
            new = {x for k in keys for x in k if x not in self.chunks}
        here: dict[str, bytes] = {k: b"" for k in new if len(k) > CACHE_CHARS}  # not cached
        # a blank and ASCII letters are one pre-token
        cut = {k: [" " + k] if k.isascii() and k.isalpha() else PRE_TOKEN.findall(chunk_text(k)) for k in new}
        ids = self._ids_of_words({w for words in cut.values() for w in words})
        for k, words in cut.items():
            (here if k in here else self.chunks)[k] = b"".join(map(ids.__getitem__, words))
        get = self.chunks.get
        return [b"".join([here[x] if (got := get(x)) is None else got for x in k]) for k in keys]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        pieces = [(doc, x[i : i + 4 * PIECE_TOKENS]) for doc, x in enumerate(ids) for i in range(0, len(x), 4 * PIECE_TOKENS)]
        out: list[list[bytes]] = [[] for _ in ids]
        start = 0
        while start < len(pieces):
            stop, held = start, 0
            while stop < len(pieces) and (stop == start or held + len(pieces[stop][1]) // 4 <= DECODE_TOKENS):
                held += len(pieces[stop][1]) // 4
                stop += 1
            part = [x for _, x in pieces[start:stop]]
            flat = np.frombuffer(b"".join(part), "<u4").astype(np.int32)
            self.con.register("tokens", pa.table({"piece": np.repeat(np.arange(len(part), dtype=np.int32), [len(x) // 4 for x in part]), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            got = self.con.sql("SELECT tokens.piece, string_agg(vocab.shown, '' ORDER BY pos) AS shown, count(*) AS n FROM tokens JOIN vocab USING (id) GROUP BY tokens.piece ORDER BY tokens.piece").to_arrow_table()
            if (n := sum(got.column("n").to_pylist())) != len(flat):
                raise ValueError(f"{len(flat) - n} ids are not in the vocabulary")
            for (doc, _), shown in zip(pieces[start:stop], got.column("shown").to_pylist()):
                out[doc].append((np.frombuffer(shown.encode("utf-16-le"), "<u2") - 256).astype(np.uint8).tobytes())
            start = stop
        return [b"".join(x) for x in out]


def worker(path: str, cache_keys: int = CACHE_KEYS) -> SqlBpe:
    return worker_state(f"bpe_sql {path} {cache_keys}", lambda: SqlBpe(path, cache_keys))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text; ids are little-endian unsigned 32-bit integers in one binary value."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for ids, texts in text_batches(batches, "doc_id", "text", 1_000_000):
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "ids": pa.array(bpe.encode(texts), pa.binary())})

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows as ``encode`` returns them; null ids decode to empty bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(bpe.decode(ids), pa.binary())})

    return two_columns(encoded, id_col, ids_col).mapInArrow(run, f"doc_id {kind}, decoded binary")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_keys: int = CACHE_KEYS) -> DataFrame:
    """(doc_id, ids, decoded): both directions in one pass of one Python worker to a task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, cache_keys)
        for keys, texts in text_batches(batches, "doc_id", "text", 1_000_000):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "ids": pa.array(ids, pa.binary()), "decoded": pa.array(bpe.decode(ids), pa.binary())})

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
