"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one blank; the 1-, 2- and 3-grams of that string are hashed into
``N_FEATURES`` buckets. The log-probability matrix (features x languages, its size fixed by the parameters and the
number of labels) is broadcast; a batch of texts is scored by gathering matrix rows and summing them to a text.

``fit`` learns from a sample with a documented bound: about ``rows_per_label`` texts of each label, those whose hashed id
is smallest, found by a threshold from the label's own count; no sort and no collection of texts. Counts are summed on
the executors and only the matrix reaches the driver.

The posterior is shared out among the learned labels only, so it can't tell that a text is in none of them. ``accepted``
therefore also compares the mean log-likelihood of a text's n-grams under its label with what the n-grams of that label's
training texts reach: a text that falls short by more than ``SLACK`` nats, and ``SHORT_SLACK`` divided by the square root of
its number of n-grams, is in no learned language.

Null text, or text without any letter: language ``und`` with score 0. Very long texts are scored whole. Ties go to the first label in order. Empty training
data: every text is ``und``. Repeated rows count again; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import filter_rows, text_batches, two_columns, worker_state

N_FEATURES = 1 << 16
UND = "und"
#: N-grams scored as one sparse matrix; a longer text is one by itself.
GRAMS_AT_ONCE = 500_000
#: Nats a n-gram below the training texts. Of check_l's 256,410 texts, all in learned languages, the furthest is 1.74 below from
#: 300 n-grams on and 3.26 (121 n-grams, a secret among them) under that; Finnish falls short by 3.9, Polish by 4.7, random
#: letters by 6. A few words of another language in Latin letters can still pass.
SLACK, SHORT_SLACK = 2.0, 16.0
#: Lower case of a code point below 2**16 if it is a letter, else a blank; above that, letters stay as they are.
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        lower = [ord(c.lower()) if len(c.lower()) == 1 else i for i, c in ((i, chr(i)) for i in range(1 << 16))]
        _FOLD = np.array([lower[i] if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32)
    return _FOLD


def features(text: str) -> np.ndarray:
    """Bucket of every n-gram of the whole text; empty if it holds no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points >= 1 << 16
    folded = _fold()[np.where(high, 0, points)]
    if high.any():
        folded[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
    if not (folded != 32).any():
        return np.zeros(0, np.int64)
    blank = folded == 32
    keep = np.append(True, ~(blank[1:] & blank[:-1]))
    x = np.concatenate([[32], folded[keep], [32]]).astype(np.uint64)
    two = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + x[2:]
    grams = np.concatenate([x[1:-1] + np.uint64(7), two * np.uint64(3), three])
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (grams >> np.uint64(40)).astype(np.int64) & (N_FEATURES - 1)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    #: log P(feature | label), features x labels, and log P(label)
    weights: np.ndarray
    priors: np.ndarray
    #: Mean log-likelihood of an n-gram of the label's training texts
    own: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Label and posterior probability, its logarithm divided by the square root of the number of n-grams."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Label and score as in ``score``, and whether the text's n-grams are as likely as the label's own, less the slack."""
        names, scores, alike = [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if not self.labels:
            return names, scores, alike
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0
        for i, text in enumerate(texts):
            at = features(text)
            if len(at):
                held.append((i, at))
                waiting += len(at)
            if held and (waiting >= GRAMS_AT_ONCE or i == len(texts) - 1):
                self._batch(held, names, scores, alike)
                held, waiting = [], 0
        if held:
            self._batch(held, names, scores, alike)
        return names, scores, alike

    def _batch(self, held: list[tuple[int, np.ndarray]], names: list[str], scores: list[float], alike: list[bool]) -> None:
        """Fills in the results of (text, features): one sparse matrix of counts, text by feature, times the weights."""
        sizes = np.array([len(at) for _, at in held])
        cells, times = np.unique(np.concatenate([n * N_FEATURES + at for n, (_, at) in enumerate(held)]), return_counts=True)
        first = np.searchsorted(cells, np.arange(len(held)) * N_FEATURES)
        logs = np.add.reduceat(times[:, None] * self.weights[cells % N_FEATURES], first, axis=0, dtype=np.float64) + self.priors
        best = logs.argmax(axis=1)
        top = logs[np.arange(len(held)), best]
        like = (top - self.priors[best]) / sizes >= self.own[best] - SLACK - SHORT_SLACK / np.sqrt(sizes)
        chance = 1 / np.exp((logs - top[:, None]) / np.sqrt(sizes)[:, None]).sum(axis=1)
        for (i, _), b, c, ok in zip(held, best.tolist(), chance.tolist(), like.tolist()):
            names[i], scores[i], alike[i] = self.labels[b], c, ok


def fit(docs: DataFrame, label: Column, rows_per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the rows of ``docs`` whose ``label`` isn't null."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").alias("text"), label.alias("label")).where("label is not null and text is not null")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = tuple(sorted(x for x in sizes if x != UND))
    if not labels:
        return Model((), np.zeros((N_FEATURES, 0), np.float32), np.zeros(0), np.zeros(0))
    # hash in 0..2**20: a label of n rows gives n * share of them
    share = F.create_map(*[F.lit(x) for l in labels for x in (l, min(1.0, rows_per_label / sizes[l]))])
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20)).select("label", "text")
    index = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        total = np.zeros((len(labels), N_FEATURES), np.int64)
        docs_of = np.zeros(len(labels), np.int64)
        for names, texts in text_batches(batches, "label", "text"):
            for name, text in zip(names.to_pylist(), texts):
                if name in index:
                    total[index[name]] += np.bincount(features(text), minlength=N_FEATURES)
                    docs_of[index[name]] += 1
        at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(at[0], pa.int32()), "feature": pa.array(at[1], pa.int32()), "n": pa.array(total[at], pa.int64())})
        yield pa.RecordBatch.from_pydict({"label": pa.array(range(len(labels)), pa.int32()), "feature": pa.array([-1] * len(labels), pa.int32()), "n": pa.array(docs_of, pa.int64())})

    counts = np.zeros((len(labels), N_FEATURES + 1))
    got = sample.mapInArrow(run, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[got["label"].to_numpy(), got["feature"].to_numpy()] = got["n"].to_numpy()
    smooth = counts[:, :-1] + 0.5
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
    own = (counts[:, :-1] * weights.T).sum(axis=1) / np.maximum(1, counts[:, :-1].sum(axis=1))
    return Model(labels, np.ascontiguousarray(weights), np.log((counts[:, -1] + 1) / (counts[:, -1] + 1).sum()), own)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        held = shared.value
        for ids, texts in text_batches(batches, "doc_id", "text"):
            names, scores = held.score(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows, whole, that get a learned language with at least ``min_score`` and whose n-grams are those of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    begun: list[bool] = []

    def keep(texts: list[str]) -> list[bool]:
        if not begun:
            begun.append(True)
            worker_state("langid")
        return [name != UND and score >= min_score and like for name, score, like in zip(*shared.value.judge(texts))]

    return filter_rows(docs, keep, text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model never learns from: crc32 of the id as text leaves 2 when divided by 4 (false without an id)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
