"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix, which are put in another order.

Units are code points. Characters fall into four classes by the bytes that their UTF-8 form takes, so within a run of one
class a unit's place is arithmetic. For every batch of texts the maximal runs are stored as (first byte, units before the
run, bytes a unit). A cut is found by binary search for its run; so are the units before a text, from its first byte.

The cuts and the form come from the SHA-256 of ``{salt}:{id}`` (its first four 8-digit groups h1 to h4), so a run can be
repeated, and a document's form does not depend on the partition it lies in:

* prefix and middle end after the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units;
* the form is ``plain`` (the text as it is) if the text is empty or holds a sentinel, or if ``h3 % 100 >= fim_percent``;
  else ``spm`` (suffix first) if ``h4 % 100 < spm_percent``; else ``psm``.

Texts are read and written whole, in one pass without a shuffle. Null text is empty; a row without id is hashed as
``{salt}:``; repeated rows give repeated results; there are no ties. Empty tables give no rows. A very long text makes a
batch of its own. Columns other than id and text are not read, so their names can't clash. Texts are valid UTF-8, as
Spark's are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_type, two_columns, worker_state

#: Bytes of text whose runs are stored at once.
RUN_BYTES = 4_000_000
#: A first byte's class: the bytes of its code point; 0 for bytes that continue one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


@dataclass(frozen=True)
class Forms:
    """Sentinels and shares of the forms."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fim_percent: int = 90
    spm_percent: int = 20
    salt: str = "1"

    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Runs:
    """Maximal runs of one character class in a buffer of UTF-8 texts."""

    def __init__(self, data: np.ndarray):
        widths = _WIDTH[data]
        widths = widths[widths > 0]
        self.units = np.flatnonzero(np.append(True, widths[1:] != widths[:-1])[: len(widths)])
        self.width = widths[self.units].astype(np.int64)
        self.total = len(widths)
        long = np.diff(np.append(self.units, self.total))
        self.bytes = np.append(0, np.cumsum(long * self.width))[: len(self.units)]

    def unit_at(self, at: np.ndarray) -> np.ndarray:
        """Units before the byte ``at``, the first of a code point or the buffer's end."""
        return self._through(at, self.bytes, self.units, lambda past, width: past // width)

    def byte_at(self, unit: np.ndarray) -> np.ndarray:
        return self._through(unit, self.units, self.bytes, lambda past, width: past * width)

    def _through(self, x: np.ndarray, known: np.ndarray, wanted: np.ndarray, step) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), np.int64)
        run = np.searchsorted(known, x, "right") - 1
        return wanted[run] + step(x - known[run], self.width[run])


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``RUN_BYTES``; a longer text comes alone."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + RUN_BYTES, "right")) - 1)
        yield start, stop
        start = stop


def fill_in_middle(docs: DataFrame, forms: Forms = Forms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; the lengths are null if the form is plain."""
    rows = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat_ws(":", F.lit(forms.salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = (F.length("text") == 0) | (h[2] % 100 >= forms.fim_percent)
    for mark in forms.sentinels():
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < forms.spm_percent, "spm").otherwise("psm")
    kind = docs.schema[id_col].dataType.simpleString()
    marks = [x.encode() for x in forms.sentinels()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("fill_in_middle")
        for batch in batches:
            ids, text, shape, h1, h2 = batch.columns
            text = text.cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for start, stop in _slices(offsets):
                at = offsets[start : stop + 1]
                part = data[at[0] : at[-1]]
                shapes = shape.slice(start, stop - start)
                found = _cuts(Runs(part), at - at[0], h1.slice(start, stop - start), h2.slice(start, stop - start))
                n, one, two, cuts = found
                outputs = [_arranged(memoryview(part), x, *c, marks) for x, c in zip(shapes.to_pylist(), cuts.tolist())]
                null = np.array([x == "plain" for x in shapes.to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.array(n), shapes, pa.array(one, mask=null), pa.array(two - one, mask=null), pa.array(outputs, pa.binary()).cast(pa.string())], names)

    asked = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return asked.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _cuts(runs: Runs, at: np.ndarray, h1: pa.Array, h2: pa.Array) -> tuple[np.ndarray, ...]:
    """Units of every text, ends of its prefix and middle in units, and (start, both ends, end) in bytes of the buffer."""
    before = runs.unit_at(at)
    n = np.diff(before)
    ends = np.sort(np.stack([h.to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for h in (h1, h2)]), axis=0)
    inner = [runs.byte_at(before[:-1] + x) for x in ends]
    return n, ends[0], ends[1], np.stack([at[:-1], *inner, at[1:]], axis=1)


def _arranged(data: memoryview, form: str, start: int, one: int, two: int, end: int, marks: list[bytes]) -> bytes:
    p, s, m = marks
    if form == "plain":
        return bytes(data[start:end])
    first, last = (p + bytes(data[start:one]), s + bytes(data[two:end]))[:: -1 if form == "spm" else 1]
    return b"".join((first, last, m, data[one:two]))


def restored(output: Column | str, form: Column | str, forms: Forms = Forms()) -> Column:
    """The text rebuilt from output and form. Texts of the forms psm and spm hold no sentinel, so each is found once."""
    output, form = F.col(output) if isinstance(output, str) else output, F.col(form) if isinstance(form, str) else form
    after = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    p, s, m = forms.sentinels()
    middle, rest = after(output, m), before(output, m)
    psm = F.concat(after(before(rest, s), p), middle, after(rest, s))
    spm = F.concat(after(rest, p), middle, after(before(rest, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
