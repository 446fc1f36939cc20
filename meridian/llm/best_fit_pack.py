"""Best-fit packing planned on the histogram of lengths.

Documents are cut into token ids and then into pieces of at most ``capacity``. Only the histogram of
piece lengths (capacity numbers at most) reaches the driver, which runs best-fit decreasing on counts
rather than pieces. The pieces then take the planned places by joining on their rank within length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import materialize, rank_within, ragged, text_slices

#: Words that a Python worker remembers the ids of (about 40 bytes each); beyond, it starts anew.
CACHED_WORDS = 2_000_000
#: Words that the tokenizer gets at a time.
BATCH_WORDS = 20_000


class WordIds:
    """Token ids of white-space-free words by the tokenizer, remembered under 128-bit hashes.

    The tokenizer drops white space and none of its tokens spans any, so the ids of a text are those
    of its words one after the other.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # ascending
        self.check = np.zeros(0, dtype=np.uint64)
        self.row = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """A row of starts and lengths for each of the distinct words."""
        if len(self.starts) > CACHED_WORDS:
            self.clear()
        first = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        second = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        rows = np.full(len(words), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, first), len(self.known) - 1)
            hit = (self.known[at] == first) & (self.check[at] == second)
            rows[hit] = self.row[at[hit]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            self._encode([words[i].decode() for i in new.tolist()])
            new = new[np.argsort(first[new])]
            known = np.concatenate([self.known, first[new]])
            order = np.argsort(known, kind="stable")  # merges two ascending runs
            self.known = known[order]
            self.check = np.concatenate([self.check, second[new]])[order]
            self.row = np.concatenate([self.row, rows[new]])[order]
        return rows

    def _encode(self, words: list[str]) -> None:
        flat, lengths = [self.ids], [self.lengths]
        for a in range(0, len(words), BATCH_WORDS):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + BATCH_WORDS], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int32, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        self.ids, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths


_OF_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own WordIds, for all its tasks (a task's function brings copies of the globals it names itself)."""
    if path not in _OF_WORKER:
        _OF_WORKER[path] = WordIds(path)
    return _OF_WORKER[path]


def _word_table(words: WordIds, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words one after the other, where each word starts and how many it has.

    The tokenizer lower-cases, and takes full stops and commas after a letter or digit for tokens of
    their own; so words are looked up in lower case and without them. Words that may hold a special
    token are looked up as they are.
    """
    plain = pc.invert(pc.match_substring(distinct, "<"))
    stems = pc.if_else(plain, pc.utf8_rtrim(pc.ascii_lower(distinct), ".,"), distinct)
    stems = pc.if_else(pc.match_substring_regex(stems, "[a-z0-9]$"), stems, distinct)
    sizes = pc.binary_length(stems).to_numpy(zero_copy_only=False)
    whole = distinct.cast(pa.binary())
    cut = np.flatnonzero(sizes < pc.binary_length(distinct).to_numpy(zero_copy_only=False))
    tails = [b""] * len(distinct)
    for i, w, n in zip(cut.tolist(), whole.take(pa.array(cut)).to_pylist(), sizes[cut].tolist(), strict=True):
        tails[i] = w[n:]
    coded = pa.concat_arrays([stems.cast(pa.binary()), pa.array(tails, pa.binary())]).dictionary_encode()
    rows = words.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T
    lengths = words.lengths[rows]
    flat = words.ids[ragged(words.starts[rows].ravel(), lengths.ravel())]
    per_word = lengths.sum(axis=1)
    return flat, np.cumsum(per_word) - per_word, per_word


def token_ids(words: WordIds, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, each followed by ``end``, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    table, starts, lengths = _word_table(words, coded.dictionary)
    rows = coded.indices.to_numpy(zero_copy_only=False)
    per_word = lengths[rows]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    per_text = np.diff(ends[offsets])
    flat = table[ragged(starts[rows], per_word)]
    return np.insert(flat, ends[offsets[1:]], np.uint32(end)), per_text + 1


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end: int, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids themselves."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch):
                ids, counts = token_ids(words, part.column("text"), end)
                raw, n_pieces = ids.tobytes(), -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n_pieces)
                piece = ragged(np.zeros(len(counts), np.int64), n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = (np.cumsum(counts) - counts)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, ddl)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, first offset).

    Best-fit decreasing. Sequences with the same room are held as ranges, so the work and the plan hang
    on the number of lengths, not of pieces. A sequence that takes one piece of a length is the tightest
    fit for the next one too, as long as that fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, count)
    rooms: list[int] = []  # the keys, ascending
    plan, opened = [], 0

    def put(length: int, left: int, first: int, count: int, each: int, rank: int) -> None:
        plan.append((length, rank, rank + count * each, first, each, capacity - left))
        rest = left - each * length
        if rest:
            if rest not in room:
                room[rest] = []
                bisect.insort(rooms, rest)
            room[rest].append((first, count))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                left, first, count = capacity, opened, -(-todo // (capacity // length))
                opened += count
            each = left // length
            full = min(count, todo // each)
            if full:
                put(length, left, first, full, each, rank)
                rank, todo = rank + full * each, todo - full * each
            if full < count and todo:
                put(length, left, first + full, 1, todo, rank)
                rank, todo, full = rank + todo, 0, full + 1
            if full < count:
                if left not in room:
                    room[left] = []
                    bisect.insort(rooms, left)
                room[left].append((first + full, count - full))
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row for each piece.

    Null text is empty and yields the end id alone; a null doc_id is kept; repeated rows are packed one
    by one; an empty table gives no rows; other columns are ignored. Documents longer than the capacity
    are cut into full pieces and a rest.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity, end, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = spark.createDataFrame(
        plan_best_fit(histogram, capacity), "length long, lo long, hi long, first long, each long, offset0 long"
    )
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    # The plan's rows hang on the number of lengths alone.
    placed = ranked.join(F.broadcast(plan), "length").filter("rank >= lo and rank < hi")
    step = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
