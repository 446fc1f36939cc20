"""Fill-in-the-middle rewriting: a text is cut at two unit ends, and its middle goes to the back.

Where units end is found on eight bytes at a time: the UTF-8 bytes of a batch are viewed as 64-bit words,
arithmetic on a word sets the high bit of each byte that ends a unit, and counts of these bits, added up
word by word, give both the number of units before any byte and, searched, the word that holds the k-th
end; the place in this word is then found by halving it.

A text that is empty, or holds a sentinel string itself, or is not chosen, stays plain. As no other text
holds a sentinel, an output can always be taken apart again (restore).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small_batches, text_slices

#: The control strings before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "char")
BATCH_ROWS = 512

HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE, SEVEN, EIGHT = np.uint64(1), np.uint64(7), np.uint64(8)


def newline_marks(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is a line end; exact, as no byte carries into the next."""
    x = words ^ NEWLINES
    return ~(((x & LOW7) + LOW7) | x) & HIGH


def lead_marks(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that begins a code point (all but 10xxxxxx)."""
    return HIGH & ~(words & ~(words << ONE))


class Marks:
    """Marked bytes of a buffer of whole words, ready to be counted and found."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.append(0, np.cumsum(np.bitwise_count(marks), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marks at the bytes before ``at``."""
        word = at >> 3
        below = (ONE << ((at & 7).astype(np.uint64) * EIGHT)) - ONE
        padded = np.append(self.marks, np.uint64(0))
        return self.before[word] + np.bitwise_count(padded[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark of the buffer, counted from 0; there must be so many."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left = (k - self.before[word]).astype(np.uint8)
        rest, at = self.marks[word], np.zeros(len(k), np.int64)
        for width in (4, 2, 1):  # bytes: into the upper half where the lower one has too few marks
            lower = rest & ((ONE << np.uint64(8 * width)) - ONE)
            count = np.bitwise_count(lower)
            up = left >= count
            left = np.where(up, left - count, left)
            rest = np.where(up, rest >> np.uint64(8 * width), lower)
            at += np.where(up, width, 0)
        return (word << 3) + at


class Units:
    """The texts of an Arrow column and the units they fall into."""

    def __init__(self, texts: pa.LargeStringArray, unit: str) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = np.zeros(last - first + 7 >> 3, np.uint64)  # the last word is filled up with zeros
        if last > first:
            data.view(np.uint8)[: last - first] = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        self.bytes, self.start, self.end = data.view(np.uint8), offsets[:-1] - first, offsets[1:] - first
        self.leads = Marks(lead_marks(data))
        if unit == "char":
            # A code point ends where the next one begins: the marks move down a byte, over word bounds too.
            marks = self.leads.marks
            self.ends = Marks(marks >> EIGHT | np.append(marks[1:], HIGH) << np.uint64(56))
        else:
            self.ends = Marks(newline_marks(data))
        self.base = self.ends.rank(self.start)
        filled = self.end > self.start
        tail = np.zeros(len(self.start), bool)
        closed = self.ends.marks.view(np.uint8)[self.end[filled] - 1] == 0x80
        tail[filled] = ~closed  # the end of a text ends its last unit, too
        self.n = self.ends.rank(self.end) - self.base + tail

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Byte after the first k units of each text."""
        out = np.where(k > 0, self.end, self.start)
        inside = np.flatnonzero((k > 0) & (k < self.n))
        out[inside] = self.ends.select(self.base[inside] + k[inside] - 1) + 1
        return out

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.leads.rank(b) - self.leads.rank(a)


def _pieces(units: Units, bounds: list[np.ndarray]) -> list[pa.LargeStringArray]:
    """The texts between one bound and the next, as Arrow columns over one buffer."""
    flat = np.append(np.column_stack(bounds[:-1]).ravel(), bounds[-1][-1:] if len(bounds[-1]) else [0]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(flat) - 1, pa.py_buffer(flat), pa.py_buffer(units.bytes))
    return [whole.take(pa.array(np.arange(i, len(flat) - 1, len(bounds) - 1))) for i in range(len(bounds) - 1)]


def rewrite(texts: pa.Array, draws: np.ndarray, unit: str, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; draws has its four numbers."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    units = Units(texts, unit)
    barred = units.end == units.start
    for control in (PREFIX, SUFFIX, MIDDLE):
        barred |= pc.match_substring(texts, control).to_numpy(zero_copy_only=False)
    plain = barred | (draws[:, 2] % 100 >= fim_percent)
    cuts = np.sort(draws[:, :2] % (units.n + 1)[:, None], axis=1)
    one, two = units.cut(cuts[:, 0]), units.cut(cuts[:, 1])
    spm = draws[:, 3] % 100 < spm_percent
    prefix, middle, suffix = _pieces(units, [units.start, one, two, units.end])
    joined = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    control = lambda c: pa.scalar(c, pa.large_string())
    forms = pa.array(np.select([plain, spm], ["plain", "spm"], "psm"), pa.string())
    output = pc.if_else(
        pa.array(plain), texts,
        pc.if_else(
            pa.array(spm), joined(control(SUFFIX), suffix, control(PREFIX), prefix, control(MIDDLE), middle),
            joined(control(PREFIX), prefix, control(SUFFIX), suffix, control(MIDDLE), middle),
        ),
    )
    return [pa.array(units.n), forms, pa.array(units.chars(units.start, one), mask=plain), pa.array(units.chars(one, two), mask=plain), output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """docs and n, form, prefix_chars, middle_chars (null where plain), output: one row each.

    unit: 'line' (line ends belong to their lines) or 'char' (code points). Numbers h1 to h4 are the first
    four 8-digit groups of the sha256 of seed, a colon and doc_id; cuts are at h1 and h2 modulo n + 1, a
    document is rewritten where h3 % 100 < fim_percent, as spm where h4 % 100 < spm_percent, else as psm.

    A null text counts as empty and stays plain with n 0. A null doc_id draws as an empty string would.
    Rows that share a doc_id, or are repeated, are each rewritten, with the same draws. An empty table gives
    no rows. Columns of docs with names of the new ones are replaced; all others are kept as they are.
    """
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}, not {unit}")
    made = "n long, form string, prefix_chars long, middle_chars long, output string"
    names = [part.split()[0] for part in made.split(", ")]
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    (draws,) = fresh(kept, "draws")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    ready = kept.withColumn(draws, numbers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                drawn = part.column(draws).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                more = rewrite(part.column("text"), drawn, unit, fim_percent, spm_percent)
                own = part.drop_columns([draws])
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return ready.mapInArrow(work, f"{schema}, {made}")


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made from; null for null."""
    parts = F.split(F.substr(output, F.lit(4)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
