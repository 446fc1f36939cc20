"""Exact Jaccard metric-space join of documents by their word shingles.

Jaccard distance is a metric on sets, and so is the size of the symmetric difference. Documents x and y
link when |x ^ y| <= s * (|x| + |y|), with s = (1 - t) / (1 + t) for the similarity t. Regions of
documents are made by pivots and join recursively:

* The first pivot is the empty set, from which the difference of a document is its whole set. Documents
  are dealt into a region for each shingle of their window, rarest first: of two that link, both hold
  one of the first |x| - ceil(t |x|) + 1 shingles of the other. Document pivots alone can't begin: texts
  without a common shingle are all at distance 1, where the triangle inequality rules nothing out.
* A region with many documents takes one of them as its pivot p, the one that most regions share, and
  measures all others against it. Those that link with p are its cell: one component, so no two of them
  need to be compared. Those within 2 (1 - t) are the window of the triangle inequality: a text beyond it
  links with none of the cell. A wider window is as exact, and fewer documents are left for further pivots,
  so similarities to p from t - 1/2 on count. What does not link with p stays and takes further pivots, four
  times as many in each turn.
* Links connect components, which are carried from turn to turn: documents of one component are not compared
  any more, and a region that holds one component is done.
* Where more than one component is left around a pivot, its cell and window are dealt into regions again, now
  by the elements of x ^ p: as x ^ y = (x ^ p) ^ (y ^ p), two that link and do not both link with p share some,
  and each lacks at most |x| (1 - t) / t of the other's.
* With e = |x ^ p|, c the elements of x ^ p from the shared one on, and a = e - s |x|: two documents of a
  region can link only if a of each is at most 2 c - a of the other. So the least a of a region tells
  which of its documents have no partner left, without a comparison; texts that differ from p in ways of
  their own leave like that, however many they are.
* A region that is small enough for a task is never listed pair by pair. Its documents are first measured against
  one pivot, so that most of what is alike is one component. Then a kernel compares those of different components by
  bits that bound |x ^ y| from below, and only what may link leaves it: for each document the nearest such one, and
  when these have connected more, all that are left. A text is thus sent to be measured a few times, however many
  are like it. What is too large after all turns is compared block by block in the same way.

Orders, sizes of regions and numbers of pivots change the cost, never the result. Shingles are 64-bit
hashes and sets are named by 128-bit ones; documents with equal sets are one, their head.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Tables, fresh, materialize, ragged, small_batches, text_slices

#: Shingles told to be frequent and so used as the last pivots; 16 bytes each are broadcast.
FREQUENT = 200_000
#: Documents of one slice of the corpus that must hold a shingle for it to be proposed as frequent.
PROPOSE_FROM = 2
#: A region of at most so many documents is compared by sketches within a task; a larger one takes pivots.
SMALL_REGION = 2048
#: Longest sketches (64-bit words) that are sent to regions, rows of regions and pairs that a task compares at a time.
SKETCH_WORDS, ROWS_AT_A_TIME, PAIRS_AT_A_TIME = 32, 16_384, 100_000
#: Most document pivots of a region in a turn, and turns before what is left is compared block by block. More turns deal out documents that
#: lie around one pivot and do not link again and again.
PIVOTS, TURNS = 64, 2
#: Turns of which the last deals documents by what tells them from their pivots; the others take pivots.
DEAL_AFTER = 2
#: Documents in candidate pairs up to which their ids (24 bytes) are sent to the texts; beyond, both are shuffled.
BROADCAST_IDS = 1_000_000
#: Texts, and pairs of texts, of an Arrow batch.
TEXTS_A_BATCH, PAIRS_A_BATCH = 1000, 250
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingle hashes of each text, text after text and ascending, and how many each has.

    A-Z are lower-cased, words are split at ASCII white space; a text with fewer than k words is one
    shingle, one without words has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    keep = pc.not_equal(pc.binary_length(words), 0)
    offsets = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
    if not pc.all(keep).as_py():
        kept = keep.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        words = words.filter(keep)
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    n_words = np.diff(offsets)
    n_shingles = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    rolled = _mix(h + np.uint64(k))
    for j in range(1, k):
        rolled = _mix(rolled[: len(h) - j] * _ODD[0] + h[j:]) if len(h) > j else rolled[:0]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    row = np.repeat(np.arange(len(texts)), n_shingles)
    at = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    values = np.zeros(len(row), np.uint64)
    full = (n_words >= k)[row]
    values[full] = rolled[at[full]]
    ends = np.cumsum(n_shingles)
    for i in short.tolist():
        values[ends[i] - 1] = xxhash.xxh3_64_intdigest(h[offsets[i] : offsets[i + 1]].tobytes(), seed=k)
    order = _sort_within(values, row)
    values, row = values[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[first], np.bincount(row[first], minlength=len(texts))


def _sort_within(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order by row, then value: row is ascending already."""
    ends = np.flatnonzero(np.diff(row)) + 1
    order = np.empty(len(row), np.int64)
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(row)], strict=True):
        order[a:b] = a + np.argsort(values[a:b])
    return order


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The shingles that most documents seem to hold, least frequent first; only their order as pivots hangs on it."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                values, counts = np.unique(shingle_sets(part.column("text"), k)[0], return_counts=True)
                often = counts >= PROPOSE_FROM
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["g", "n"])

    counted = docs.select("text").mapInArrow(propose, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "g").limit(FREQUENT)
    return top.select("g").toArrow()["g"].to_numpy().astype(np.int64).view(np.uint64)[::-1]


class Rarity:
    """Order of shingles as pivots: those not told to be frequent by their hash, then the others by frequency."""

    def __init__(self, rarest_first: np.ndarray) -> None:
        order = np.argsort(rarest_first)
        self.often, self.rank = rarest_first[order], order.astype(np.int64)

    def ranks(self, values: np.ndarray) -> np.ndarray:
        """Place among the frequent ones from 0, or -1."""
        if not len(self.often):
            return np.full(len(values), -1, np.int64)
        at = np.minimum(np.searchsorted(self.often, values), len(self.often) - 1)
        return np.where(self.often[at] == values, self.rank[at], -1)


def sketches(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the parity sketches of all sets, one after the other, and how many each has.

    Bit i tells whether the set holds an odd number of values that are i modulo the number of bits, the
    power of two that is from two to four times the size of the set (512 at least). Sets that differ in d
    values differ in d bits at most; the exclusive or of the halves of a sketch is the sketch of half the length.
    """
    words = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(counts, 1) / 32)).astype(np.int64))
    starts = np.cumsum(words) - words
    row = np.repeat(np.arange(len(counts)), counts)
    at = 64 * starts[row] + (values % (64 * words[row]).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), words


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))


SETS = "doc_id long, text_hash long, n long, signature binary, window array<long>, bits array<long>"


def shingled(texts: DataFrame, k: int, percent: int, rarity: Broadcast) -> DataFrame:
    """doc_id, text_hash, n (size of the set), its signature (16 bytes), its window of pivots and its sketch, a row for each row."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                values, counts = shingle_sets(part.column("text"), k)
                ranks = rarity.value.ranks(values)
                ends = np.cumsum(counts)
                width = np.where(counts > 0, counts - -(-percent * counts // 100) + 1, 0)
                signatures, windows = [], [np.zeros(0, np.uint64)]
                for a, b, w in zip((ends - counts).tolist(), ends.tolist(), width.tolist(), strict=True):
                    own, rank = values[a:b], ranks[a:b]
                    signatures.append(xxhash.xxh3_128_digest(own.tobytes()))
                    first = own[rank < 0][:w]
                    if len(first) < w:
                        late = np.flatnonzero(rank >= 0)
                        first = np.concatenate([first, own[late[np.argsort(rank[late])][: w - len(first)]]])
                    windows.append(first)
                bits, words = sketches(values, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_hash"), pa.array(counts.astype(np.int64)), pa.array(signatures, pa.binary()),
                        _lists(width, np.concatenate(windows).view(np.int64)), _lists(words, bits),
                    ],
                    names=[f.split()[0] for f in SETS.split(", ")],
                )

    return texts.mapInArrow(shingle, SETS)


def _room(percent: int, c: str = "") -> tuple[Column, Column]:
    """a and 2 c - a of the module's description, in whole numbers: 100 + percent times as much."""
    n, e, pos = F.col(f"n{c}"), F.col(f"e{c}"), F.col(f"pos{c}")
    a = (100 + percent) * e - (100 - percent) * n
    return a, 2 * (100 + percent) * (e - pos) - a


def _star_pairs(regions: DataFrame) -> DataFrame:
    """Pairs (a, b) of the documents of each region with one of it, the one that most regions share."""
    score = regions.groupBy("doc").agg(F.count("*").alias("regions"))
    best = F.max(F.struct("regions", F.xxhash64("doc"), "doc"))["doc"].alias("b")
    pivots = regions.join(score, "doc").groupBy("region").agg(best)
    return regions.select("region", F.col("doc").alias("a")).join(pivots, "region").filter("a != b").select("a", "b").distinct()


def _blocks(regions: DataFrame) -> DataFrame:
    """regions (with their sizes) of any size as small ones: every two documents of a region meet in a block."""
    half = max(SMALL_REGION // 2, 1)
    n = F.ceil(F.col("size") / half).cast("int")
    own = F.pmod(F.xxhash64("doc", F.lit(7)), n).cast("int")
    each = regions.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("region", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))).select(REGION)


def _folded(bits: str) -> Column:
    """The sketch in column bits, cut to SKETCH_WORDS words at most."""
    short = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda i: F.aggregate(
        F.sequence(F.lit(0), (F.size(bits) / SKETCH_WORDS).cast("int") - 1), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(bits, i + j * SKETCH_WORDS))
    ))
    return F.when(F.size(bits) <= SKETCH_WORDS, F.col(bits)).otherwise(short)


def near_pairs(docs: dict[str, np.ndarray], words: np.ndarray, bits: np.ndarray, percent: int, nearest: bool) -> np.ndarray:
    """Rows (a, b) of the documents of whole regions, sorted by region, that may link and whose components and keys differ.

    docs: region, doc, n, key, comp, and a and room of the module's description; words and bits: lengths of their
    sketches and these, one after the other. With nearest only the pair that is nearest by its sketch, for each document of a region.
    """
    rows = len(words)
    starts, levels = np.cumsum(words) - words, {}
    for length in np.unique(words).tolist():
        # Sketches of this length, longer ones cut to it.
        own = np.zeros((rows, length), np.uint64)
        for more in np.unique(words[words >= length]).tolist():
            which = np.flatnonzero(words == more)
            whole = bits[starts[which][:, None] + np.arange(more)].view(np.uint64)
            own[which] = np.bitwise_xor.reduce(whole.reshape(len(which), more // length, length), axis=1)
        levels[length] = own
    edge = np.append(np.flatnonzero(np.diff(docs["region"])) + 1, rows)
    last = edge[np.searchsorted(edge, np.arange(rows), side="right")]
    todo = last - np.arange(rows) - 1
    piece = np.cumsum(todo) // PAIRS_AT_A_TIME
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), rows]
    n, a, room, key, comp = (docs[c] for c in ("n", "a", "room", "key", "comp"))
    found, apart = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        i = np.repeat(np.arange(lo, hi), todo[lo:hi])
        j = ragged(np.arange(lo, hi) + 1, todo[lo:hi])
        may = (comp[i] != comp[j]) & (key[i] != key[j]) & (a[i] <= room[j]) & (a[j] <= room[i])
        may &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[may], j[may]
        common = np.minimum(words[i], words[j])
        for length in np.unique(common).tolist():
            x, y = i[common == length], j[common == length]
            least = np.bitwise_count(levels[length][x] ^ levels[length][y]).sum(axis=1, dtype=np.int64)
            fits = (100 + percent) * least <= (100 - percent) * (n[x] + n[y])
            found.append(np.stack([x[fits], y[fits]], axis=1))
            apart.append(least[fits] / (n[x] + n[y])[fits])
    pairs = np.concatenate(found)
    if nearest and len(pairs):
        far, both = np.tile(np.concatenate(apart), 2), np.concatenate([pairs, pairs[:, ::-1]])
        order = np.lexsort((docs["doc"][both[:, 1]], far, both[:, 0]))
        first = np.append(True, np.diff(both[order, 0]) != 0)
        pairs = both[order][first]
    named = docs["doc"][pairs]
    return np.unique(np.sort(named, axis=1), axis=0)


def _pairs_within(regions: DataFrame, heads: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of the documents of small regions that may link and are not known to be connected (column comp)."""
    a, room = _room(percent)
    sketch = heads.select(F.col("node").alias("doc"), _folded("bits").alias("bits"))
    columns = ["region", "doc", "n", "key", "comp", "a", "room"]
    rows = regions.select("region", "doc", "n", "key", "comp", a.cast("long").alias("a"), room.cast("long").alias("room"))
    sorted_ = rows.join(sketch, "doc").select(*columns, "bits").repartition("region").sortWithinPartitions("region")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            docs = {c: table.column(c).to_numpy() for c in columns}
            sketches_ = table.column("bits").combine_chunks()
            words = np.diff(sketches_.offsets.to_numpy()).astype(np.int64)
            pairs = near_pairs(docs, words, sketches_.flatten().to_numpy(), percent, nearest)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        kept, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            count += batch.num_rows
            if count >= ROWS_AT_A_TIME:
                whole = pa.Table.from_batches(kept).combine_chunks()
                region = whole.column("region").to_numpy()
                # The last region may go on in the next batch.
                cut = int(np.searchsorted(region, region[-1]))
                if cut:
                    yield found(whole.slice(0, cut).combine_chunks())
                kept = whole.slice(cut).to_batches()
                count = len(whole) - cut
        if kept:
            yield found(pa.Table.from_batches(kept).combine_chunks())

    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def _alive(regions: DataFrame, percent: int, by: str) -> DataFrame:
    """regions without the documents that have no partner: none that differs in column by and leaves room for enough common elements."""
    a, room = _room(percent)
    least = regions.groupBy("region", by).agg(F.min(a).alias("a"))
    first = least.groupBy("region").agg(F.min(F.struct("a", by)).alias("first"))
    second = least.join(first, "region").filter(F.col(by) != F.col(f"first.{by}")).groupBy("region").agg(F.min("a").alias("second"), F.first("first").alias("first"))
    # A region with one value has no second and so no partners at all.
    partner = F.when(F.col(by) == F.col(f"first.{by}"), F.col("second")).otherwise(F.col("first.a"))
    return regions.join(second, "region").filter(partner <= room).select(regions.columns)


def _sized(regions: DataFrame) -> DataFrame:
    """regions with the size of each, without those of one document."""
    return regions.join(regions.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1"), "region")


class Corpus:
    """Heads of the documents with equal sets, and how to get at their texts."""

    def __init__(self, texts: DataFrame, heads: DataFrame, k: int, percent: int, rarity: Broadcast, tables: Tables) -> None:
        self.texts, self.heads, self.k, self.percent, self.rarity, self.tables = texts, heads, k, percent, rarity, tables

    def may_be_near(self, pairs: DataFrame, share: int) -> DataFrame:
        """The pairs (a, b) for which sizes and sketches allow 100 * intersection >= share * union."""
        sides = [self.heads.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b")]
        length = F.least(F.size("bits_a"), F.size("bits_b"))

        def word(bits: str, i: Column) -> Column:
            """Word i of a sketch that is cut to the common length."""
            parts = F.sequence(F.lit(0), (F.size(bits) / length).cast("int") - 1)
            return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(bits, i + j * length)))

        apart = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda acc, i: acc + F.bit_count(word("bits_a", i).bitwiseXOR(word("bits_b", i))))
        sizes = F.col("n_a") + F.col("n_b")
        fits = (100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")) & ((100 + share) * apart <= (100 - share) * sizes)
        return pairs.join(sides[0], "a").join(sides[1], "b").filter(fits).select("a", "b")

    def measured(self, pairs: DataFrame, share: int, elements: bool = False) -> DataFrame:
        """a, b, n, n2 (sizes of their sets), inter, for the pairs (a, b) with 100 * intersection >= share * union.

        With elements also the window of a into regions by what tells it from b.
        """
        k, percent, rarity = self.k, self.percent, self.rarity
        pairs = self.tables.write(self.may_be_near(pairs, share), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.heads.select("node", "doc_id", "text_hash"), "node")
        ids = self.tables.write(ids, "involved")
        few = ids.count() <= BROADCAST_IDS
        own = self.texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        texts = own.join(F.broadcast(ids) if few else ids, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, "text_a"):
                    rows, windows = [], []
                    sets = [shingle_sets(part.column(c), k) for c in ("text_a", "text_b")]
                    bounds = [np.cumsum(n) for _, n in sets]
                    for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                        x, p = (v[end[i] - n[i] : end[i]] for (v, n), end in zip(sets, bounds, strict=True))
                        inter = len(np.intersect1d(x, p, assume_unique=True))
                        if 100 * inter >= share * (len(x) + len(p) - inter):
                            rows.append((a, b, len(x), len(p), inter))
                            windows.append(difference_window(x, p, inter, percent, rarity.value) if elements else np.zeros(0, np.int64))
                    columns = np.array(rows, np.int64).reshape(-1, 5).T
                    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
                    flat = np.concatenate([np.zeros(0, np.int64), *windows])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _lists(sizes, flat)], names=["a", "b", "n", "n2", "inter", "window"])

        # Pairs and texts grow with the corpus alike, so neither is broadcast.
        joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
        with small_batches(joined.sparkSession, PAIRS_A_BATCH):
            return self.tables.write(joined.mapInArrow(compare, "a long, b long, n long, n2 long, inter long, window array<long>"), "measured")


def difference_window(x: np.ndarray, p: np.ndarray, inter: int, percent: int, rarity: Rarity) -> np.ndarray:
    """The elements of x ^ p, rarest first, as far as x may meet a partner there that does not link with p if x does.

    What x adds comes before what it lacks, as its own words are rare; the latter is told apart by its sign bit's complement.
    """
    e = len(x) + len(p) - 2 * inter
    a, own = (100 + percent) * e - (100 - percent) * len(x), (100 - percent) * len(p)
    # The least a of a partner: it does not link with p, or else it differs from p by one element at least.
    least = own + 1 if 100 * inter >= percent * (len(x) + len(p) - inter) else 2 * percent - own
    width = e - -(-(a + least) // (2 * (100 + percent))) + 1
    # A partner lacks no more than so many of these elements, whatever its distance from p.
    width = min(width, (100 - percent) * len(x) // percent + 1)
    added, lacks = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
    added = added[np.lexsort((added, rarity.ranks(added)))]
    return np.concatenate([added.view(np.int64), ~lacks.view(np.int64)])[: max(int(width), 0)]


def _linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * (F.col("n") + F.col("n2") - F.col("inter"))


REGION = ["region", "doc", "n", "e", "pos", "key", "age"]


class Components:
    """Components of the documents by the links found so far."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.table = tables, None

    def of(self, df: DataFrame, document: str, name: str) -> DataFrame:
        """df with column name: the component of a document, itself without links."""
        if self.table is None:
            return df.withColumn(name, F.col(document))
        found = self.table.select(F.col("node").alias(document), F.col("component").alias(name))
        return df.join(found, document, "left").withColumn(name, F.coalesce(name, document))

    def add(self, links: DataFrame) -> None:
        """Take in links (a, b): they connect components, of which there are fewer with every turn."""
        between = self.of(self.of(links, "a", "u"), "b", "v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        merged = connected_components(between)
        if self.table is None:
            self.table = merged
            return
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = self.table.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        self.table = self.tables.write(moved.union(merged.join(self.table.select("node"), "node", "left_anti")), "components")


def _turn(large: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Documents a measured against the pivots b of large regions, and the regions without those that link with a pivot.

    Regions that choose the same first pivot are one from then on. key: documents of one key are in one
    component, or are all within the window of a pivot and so meet in its regions. Documents of the pivot's
    component (comp) are not measured and stay, for those of other components.
    """
    percent, tables = corpus.percent, corpus.tables
    share = max(2 * percent - 100, 0) // 2
    # Of whole sets the one that most regions share lies in the middle; of differences from a pivot, the least one.
    score = large.groupBy("doc").agg(F.count("*").alias("regions"))
    score_of = F.when(F.col("e") == F.col("n"), F.col("regions")).otherwise(-F.col("e")).alias("score")
    slot = F.pmod(F.xxhash64("doc", "age"), F.least(F.lit(PIVOTS), F.pow(F.lit(4), F.col("age"))).cast("long"))
    best = F.max(F.struct(score_of, F.xxhash64("doc"), "doc", "comp")).alias("best")
    chosen = large.join(score, "doc").groupBy("region", slot.alias("slot")).agg(best)
    pivots = chosen.select("region", F.col("best.doc").alias("pivot"), F.col("best.comp").alias("pivot_comp"))
    met = large.join(pivots, "region").withColumn("region", F.when(F.col("age") == 0, F.col("pivot")).otherwise(F.col("region")))
    keys = F.when(F.min("key") == F.max("key"), F.min("key")).otherwise(F.col("doc")).alias("key")
    met = tables.write(met.groupBy("region", "doc", "n", "age", "comp", "pivot", "pivot_comp").agg(keys), "met")
    pairs = met.filter("comp != pivot_comp").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    known = corpus.measured(pairs, share, elements=True).withColumn("linked", _linked(percent))
    near = known.select(F.col("a").alias("doc"), F.col("b").alias("pivot"), "inter", "linked")
    state = met.join(near, ["doc", "pivot"], "left").groupBy("region", "doc", "n", "age", "key").agg(
        F.max(F.coalesce("linked", F.col("doc") == F.col("pivot"))).alias("left"), F.max(F.struct("inter", "pivot"))["pivot"].alias("nearest"), F.max("inter").alias("inter")
    )
    rest = state.filter(~F.col("left")).withColumn("key", F.when(F.col("inter").isNotNull(), F.col("nearest")).otherwise(F.col("key")))
    return known, rest.select("region", "doc", "n", F.col("n").alias("e"), F.lit(0).alias("pos"), "key", (F.col("age") + 1).alias("age"))


def _dealt(measured: list[DataFrame], components: Components) -> DataFrame:
    """Regions by what tells documents from their pivots, for pivots around which there is more than one component."""
    known = measured[0]
    for more in measured[1:]:
        known = known.union(more)
    known = components.of(known, "a", "comp")
    open_ = known.groupBy("b").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most").select("b")
    apart = (F.col("n") + F.col("n2") - 2 * F.col("inter")).alias("e")
    dealt = known.join(open_, "b").select("a", "b", "n", apart, "linked", F.posexplode("window").alias("pos", "element"))
    key = F.when(F.col("linked"), F.col("b")).otherwise(F.col("a")).alias("key")
    return dealt.select(F.xxhash64("b", "element").alias("region"), F.col("a").alias("doc"), "n", "e", "pos", key, F.lit(0).alias("age")).select(REGION)


def linked_components(corpus: Corpus) -> DataFrame:
    """node, component (its least node) for the heads that have links."""
    percent, tables, components = corpus.percent, corpus.tables, Components(corpus.tables)
    # One exchange, of rows as short as may be, serves all that follows; n and pos share a word.
    window = F.transform("window", lambda g, i: F.struct(g.alias("region"), F.shiftleft(F.col("n"), 32).bitwiseOR(i.cast("long")).alias("place")))
    posted = corpus.heads.select(F.col("node").alias("doc"), F.explode(window).alias("post")).select("post.region", "doc", "post.place").repartition("region")
    sized = posted.withColumn("size", F.count("*").over(Window.partitionBy("region"))).filter("size > 1")
    n = F.shiftright("place", 32).alias("n")
    regions = sized.select("region", "doc", n, n.alias("e"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), F.col("doc").alias("key"), F.lit(0).alias("age"), "size")
    regions = tables.write(regions, "regions")
    first = regions.filter(F.col("size") <= SMALL_REGION).select(REGION)
    components.add(corpus.measured(_star_pairs(first), percent).select("a", "b"))
    small, waiting = [first], []
    large = regions.filter(F.col("size") > SMALL_REGION).select(REGION)
    for turn in range(TURNS):
        if not waiting and large.isEmpty():
            break
        alive = tables.write(_alive(components.of(large, "doc", "comp"), percent, "comp"), "alive")
        large = tables.write(_sized(_alive(alive, percent, "key")), "large")
        fits = F.col("size") <= SMALL_REGION
        small.append(large.filter(fits).select(REGION))
        large = large.filter(~fits)
        done = large.isEmpty()
        if done and not waiting:
            break
        if done or turn % DEAL_AFTER == DEAL_AFTER - 1:
            # By now pivots have connected most of what is alike, and few regions hold more than one component.
            large = large.select(REGION)
            large = tables.write(large.union(_dealt(waiting, components)) if waiting else large, "dealt")
            waiting = []
        else:
            known, left = _turn(large, corpus)
            large = tables.write(left, "left")
            components.add(known.filter("linked").select("a", "b"))
            waiting.append(known)
    else:
        large = large.select(REGION)
        large = large.union(_dealt(waiting, components)) if waiting else large
        small.append(_blocks(_sized(_alive(large, percent, "key"))))
    together = small[0]
    for more in small[1:]:
        together = together.union(more)
    for nearest in (True, False):
        together = tables.write(_alive(components.of(together, "doc", "comp"), percent, "comp"), "together").select(REGION)
        pairs = _pairs_within(components.of(together, "doc", "comp"), corpus.heads, percent, nearest)
        components.add(corpus.measured(pairs, percent).select("a", "b"))
    return components.table


#: Stands for a missing doc_id where rows are told apart.
NO_ID = -(2**63)


def jaccard_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component, component_id and copy_of: a row for each row of docs (doc_id, text).

    component: a number of the component, null for empty sets.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    with small_batches(spark, TEXTS_A_BATCH):
        rarity = spark.sparkContext.broadcast(Rarity(frequent_shingles(texts, k)))
        sets = materialize(shingled(texts, k, percent, rarity), "sets")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash", "n", "window", "bits")).alias("first")
    alike = sets.filter("n > 0").groupBy("signature").agg(first, F.min("doc_id").alias("copy_of"))
    # Written once, so the numbers stay.
    heads = tables.write(alike.select("signature", "first.*", "copy_of").withColumn("node", F.monotonically_increasing_id()), "heads")
    names = materialize(heads.select("signature", "copy_of", "node"), "names")
    found = materialize(linked_components(Corpus(texts, heads, k, percent, rarity, tables)), "linked")
    tables.drop()
    named = names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("copy_of").alias("component_id"))
    classes = named.join(least, "component").select("signature", "component", "component_id", "copy_of")
    return sets.join(classes, "signature", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of"),
    )


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), copy_of (least doc_id with the same set).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles. Null
    text and texts without words have empty sets and link with nothing; a text with under k words is one
    shingle. Every row gets a row, rows that share a doc_id too; where no row of a component has a doc_id,
    component_id is null. An empty table gives no rows; other columns are ignored.
    """
    return jaccard_sets(docs, k, percent).drop("text_hash", "component")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns kept, with one row of each component: the first by doc_id (null first), then by a hash of its text.

    Rows whose sets are empty all stay; of rows that are alike in doc_id and text one stays. Columns of docs
    may have any names.
    """
    found = jaccard_sets(docs, k, percent).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    best = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")).select("best.*", F.lit(False).alias("all"))
    kept = best.union(found.filter("component is null").select("doc_id", "text_hash", F.lit(True)).distinct())
    id_, hash_, all_, turn = fresh(docs, "id", "hash", "all", "turn")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), hash_: F.xxhash64("text")})
    joined = keyed.join(kept.toDF(id_, hash_, all_), [id_, hash_])
    # The join has put rows that are alike side by side, so the window needs no exchange of its own.
    numbered = joined.withColumn(turn, F.row_number().over(Window.partitionBy(id_, hash_).orderBy(id_)))
    return numbered.filter(F.col(all_) | (F.col(turn) == 1)).select(*docs.columns)
