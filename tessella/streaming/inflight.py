"""A bounded, ordered window of calls in flight, for workers that wait on a service."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(call: Callable[[Any], Any], items: Iterable[Any], width: int) -> Iterator[tuple[Any, Any, Exception | None]]:
    """(item, result, error) in the items' order, with at most ``width`` calls running.

    An item is taken only when a place is free, so ``items`` may be endless; what has ended waits for its turn, and counts
    as running, so no more than ``width`` results are held. An error stays with its item.
    """
    if width < 1:
        raise ValueError("width must be positive")
    running: deque = deque()
    with ThreadPoolExecutor(width) as threads:

        def first():
            item, future = running.popleft()
            try:
                return item, future.result(), None
            except Exception as e:
                return item, None, e

        for item in items:
            if len(running) == width:
                yield first()
            running.append((item, threads.submit(call, item)))
        while running:
            yield first()


def limited(rows: DataFrame, total: int, width: int, *by: Column | str) -> DataFrame:
    """The rows in so few partitions that tasks of ``width`` calls each make at most ``total`` calls at a time, cluster-wide.

    Dealt at random, or by the columns ``by``.
    """
    if not 1 <= width <= total:
        raise ValueError("width must lie between 1 and the total")
    parts = total // width
    return rows.repartition(parts, *by) if by else rows.repartition(parts, F.rand(0))
