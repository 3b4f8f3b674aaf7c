"""Prompts for a model in batches under a token budget, and vectors from a model's states; the models are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Ids = list[int]


@dataclass(frozen=True)
class Template:
    """Token ids around every text, for which room is kept whatever the text's length."""

    head: tuple[int, ...] = ()
    tail: tuple[int, ...] = ()
    max_length: int = 4096

    def __post_init__(self):
        if len(self.head) + len(self.tail) >= self.max_length:
            raise ValueError("the template leaves no room for a text")

    def wrap(self, ids: Ids) -> Ids:
        return [*self.head, *ids[: self.max_length - len(self.head) - len(self.tail)], *self.tail]


def budgeted(lengths: Sequence[int], budget: int) -> Iterator[np.ndarray]:
    """Places of the rows in batches of like length: the longest times the number of rows is within ``budget``.

    The longest come first, so that a worker's memory is tried at once. A row over the budget is a batch of its own.
    """
    if budget < 1:
        raise ValueError("the token budget must be positive")
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    start = 0
    while start < len(order):
        rows = max(1, budget // max(1, int(lengths[order[start]])))
        yield order[start : start + rows]
        start += rows


def score_all(texts: Sequence[str], tokenize: Callable[[str], Ids], score: Callable[[list[Ids]], Sequence[float]], template: Template, budget: int) -> np.ndarray:
    """The score of every text, in the texts' order."""
    ids = [template.wrap(tokenize(t)) for t in texts]
    out = np.full(len(ids), np.nan)
    for rows in budgeted([len(x) for x in ids], budget):
        found = np.asarray(score([ids[i] for i in rows]), float)
        if found.shape != (len(rows),):
            raise ValueError("the model gave not one score a prompt")
        out[rows] = found
    return out


def budget_scorer(load: Callable[[], tuple[Callable[[str], Ids], Callable[[list[Ids]], Sequence[float]]]], template: Template = Template(), budget: int = 32_768):
    """A scorer of prompts as a pandas UDF. ``load`` gives tokenizer and model, once a worker."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize, score = load()
        for prompts in batches:
            yield pd.Series(score_all(prompts.fillna("").tolist(), tokenize, score, template, budget))

    return scored


def left_padded(rows: list[Ids], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) as matrices, filled from the left, so that the last column is every row's last token."""
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad, np.int64), np.zeros((len(rows), width), np.int8)
    for i, row in enumerate(rows):
        if row:
            ids[i, -len(row) :], mask[i, -len(row) :] = row, 1
    return ids, mask


def last_state(states: Column | str, mask: Column | str) -> Column:
    """Of a row's states (an array of vectors, one a position) that of its last position under the mask; null if there is none.

    Right for padding on either side, and for rows of any number of positions.
    """
    states, mask = (F.col(x) if isinstance(x, str) else x for x in (states, mask))
    back = F.array_position(F.reverse(mask), 1)
    return F.when(back > 0, F.get(states, (F.size(mask) - back).cast("int")))


def unit(vector: Column | str) -> Column:
    """The vector at length one, in doubles; a zero vector, or one that is not finite, is an error."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    return F.transform(F.array(v), lambda w: _scaled(w))[0]  # v is bound once


def _scaled(w: Column) -> Column:
    norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    bad = ~(norm > 0) | F.isnan(norm) | (norm == float("inf"))
    error = F.raise_error(F.lit("a vector has no direction")).cast("double")
    return F.when(w.isNotNull(), F.transform(w, lambda x: x / F.when(bad, error).otherwise(norm)))
