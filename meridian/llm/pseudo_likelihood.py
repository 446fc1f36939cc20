"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every word of a document from the two words on either side of it; the sum of
the log-probabilities is the document's score. The most frequent words are ids of the network, all others
fall into buckets by their endings; an id is predicted in two steps, its group of 64 and its place there.
A word of a bucket is then charged for its share of the bucket, from counts of every word of the corpus
with absolute discounting; what is discounted is the share of all unseen words of the bucket together.
So the vocabulary grows with the corpus: counts of up to ``KNOWN`` words travel with the model, the others
stay a table, which documents meet in a join. A word of that table holds less than one in ``KNOWN`` of all
words, so no key of the join is hot; words there are told apart by 64-bit hashes.

Training is data-parallel: in each round every task starts from the same parameters, masks every other word
of every document it reads (the next round masks the rest), takes gradient steps in numpy, and the parameters
that the tasks end with are averaged, weighted by words, with a Spark aggregate. All documents take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_slices

SIDE, DIM, HIDDEN, GROUPS, PLACES = 2, 8, 16, 64, 64
IDS, ENDINGS = GROUPS * PLACES, 64  # id 0 is the blank before and after a text, the last 64 are buckets
OWN = IDS - ENDINGS - 1  # words with an id of their own
HASH_SEED = 42  # that of F.xxhash64
CONTEXT = [k for k in range(-SIDE, SIDE + 1) if k]
SHAPES = {
    "embed": (IDS, DIM), "mix": (2 * SIDE * DIM, HIDDEN), "mix0": (HIDDEN,), "group": (HIDDEN, GROUPS), "group0": (GROUPS,),
    "gate": (GROUPS, HIDDEN), "place": (HIDDEN, PLACES), "place0": (GROUPS, PLACES),
}
MASK_ONE_IN, BATCH, RATE = 2, 4096, 0.08
#: Words whose counts travel with the model, at most, and what absolute discounting takes off a count.
KNOWN, DISCOUNT = 100_000, 0.75
#: Bytes of ids that a kernel works on at a time, two a word.
ID_BYTES = 1 << 20
#: Words whose scores are worked out at a time, so that what is between lies in cache.
CHUNK = 2048

Params = dict[str, np.ndarray]


@dataclass
class Words:
    """The words that travel with the model: ranks from 1, by frequency."""

    ranks: dict[bytes, int]
    own: int  # words up to this rank have an id of their own
    shares: np.ndarray  # by rank, the log of a word's share of its bucket; 0 for words with an id of their own
    unseen: np.ndarray  # by bucket, the log of the share of all unseen words

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the texts one after the other: ids, log shares, and hashes of words that have no rank (0 for others); and how many words each text has."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten()
        keep = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(keep)])[np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()]
        coded = words.filter(pa.array(keep)).dictionary_encode()
        stems = folded(coded.dictionary).to_pylist()
        rank = np.fromiter((self.ranks.get(w, 0) for w in stems), np.int64, len(stems))
        bucket = np.fromiter((zlib.crc32(w[-3:]) % ENDINGS for w in stems), np.int64, len(stems))
        far = np.array([0 if r else xxhash.xxh64_intdigest(w, seed=HASH_SEED) for w, r in zip(stems, rank, strict=True)], np.uint64).view(np.int64)
        ids = np.where((rank > 0) & (rank <= self.own), rank, IDS - ENDINGS + bucket).astype(np.uint16)
        share = np.where(rank > 0, self.shares[rank], self.unseen[bucket])
        at = coded.indices.to_numpy(zero_copy_only=False)
        return ids[at], share[at], far[at], np.diff(offsets)


@dataclass
class Model:
    words: Words
    gains: DataFrame  # hash, gain: of each word without a rank, what its log share is above that of an unseen word
    params: Params


def folded(words: pa.Array) -> pa.Array:
    """Words without stops at their ends, as bytes; a word of stops alone stays."""
    bare = pc.utf8_trim(words, ".,;:!?")
    return pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare).cast(pa.binary())


def contexts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids around each word, a row each; blanks beyond the ends of its text."""
    text = np.repeat(np.arange(len(counts)), counts)
    padded = np.zeros(len(ids) + SIDE * (len(counts) + 1), np.int32)
    at = np.arange(len(ids)) + SIDE * (text + 1)
    padded[at] = ids
    return np.stack([padded[at + k] for k in CONTEXT], axis=1)


def forward(p: Params, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log-probability of each target, and what the gradient needs."""
    group, place, row = target >> 6, target & 63, np.arange(len(target))
    x = p["embed"].take(context.ravel(), axis=0).reshape(len(target), -1)
    h = x @ p["mix"] + p["mix0"]
    np.tanh(h, out=h)
    z = h @ p["group"]
    z += p["group0"]
    gated = h * p["gate"].take(group, axis=0)
    y = gated @ p["place"]
    y += p["place0"].take(group, axis=0)
    for scores in (z, y):
        np.clip(scores, -30, 30, out=scores)
    own = z[row, group] + y[row, place]
    ez, ey = np.exp(z, out=z), np.exp(y, out=y)
    sz, sy = (e @ np.ones(e.shape[1], e.dtype) for e in (ez, ey))
    return own - np.log(sz) - np.log(sy), (x, h, gated, ez, sz, ey, sy, group, place, row)


def _scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, d], size) for d in range(values.shape[1])], axis=1).astype(np.float32)


def gradient(p: Params, context: np.ndarray, target: np.ndarray) -> Params:
    """Gradient of the mean negative log-probability."""
    # Targets of one group lie together, so that what belongs to a group is summed as a block.
    order = np.argsort((target >> 6).astype(np.uint8), kind="stable")
    context, target, n = context[order], target[order], np.float32(len(target))
    out = {k: np.zeros(shape, np.float32) for k, shape in SHAPES.items()}
    dx = np.empty((len(target), p["mix"].shape[0]), np.float32)
    for a in range(0, len(target), CHUNK):
        _, (x, h, gated, dz, sz, dy, sy, group, place, row) = forward(p, context[a : a + CHUNK], target[a : a + CHUNK])
        dz /= (sz * n)[:, None]
        dy /= (sy * n)[:, None]
        dz[row, group] -= 1 / n
        dy[row, place] -= 1 / n
        dgated = dy @ p["place"].T
        dh = (dz @ p["group"].T + dgated * p["gate"].take(group, axis=0)) * (1 - h * h)
        dx[a : a + CHUNK] = dh @ p["mix"].T
        first = np.flatnonzero(np.diff(group, prepend=-1))
        for k, values in (("gate", dgated * h), ("place0", dy)):
            out[k][group[first]] += np.add.reduceat(values, first, axis=0)
        for k, values in (("mix", x.T @ dh), ("mix0", dh.sum(axis=0)), ("group", h.T @ dz), ("group0", dz.sum(axis=0)), ("place", gated.T @ dy)):
            out[k] += values
    return out | {"embed": _scatter(context.ravel(), dx.reshape(-1, DIM), IDS)}


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float64)


def unpack(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def start(counts: np.ndarray, seed: int) -> Params:
    """Small random weights; the biases give the word frequencies of the corpus."""
    draw = np.random.default_rng(seed)
    p = {k: (draw.normal(size=shape) * 0.1).astype(np.float32) for k, shape in SHAPES.items()}
    by = (counts + 0.5).reshape(GROUPS, PLACES)
    p |= {"mix": (draw.normal(size=SHAPES["mix"]) / np.sqrt(2 * SIDE * DIM)).astype(np.float32), "gate": np.ones(SHAPES["gate"], np.float32)}
    share = by.sum(axis=1) / by.sum()
    return p | {"mix0": np.zeros(HIDDEN, np.float32), "group0": np.log(share).astype(np.float32), "place0": np.log(by / by.sum(axis=1, keepdims=True)).astype(np.float32)}


def vocabulary(docs: DataFrame, known: int = KNOWN, most_own: int = OWN) -> tuple[Words, DataFrame, np.ndarray]:
    """The most frequent words with a rank, the table of all others, and the frequency of every id, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column("text"), ""))).flatten()
                seen = words.filter(pc.not_equal(pc.binary_length(words), 0)).value_counts()
                yield pa.RecordBatch.from_arrays([folded(seen.field("values")), seen.field("counts").cast(pa.int64())], names=["word", "n"])

    summed = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    bucket = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int")
    counted = materialize(summed.select("word", "n", bucket.alias("bucket"), F.floor(F.log2("n") * 16).cast("int").alias("octave")), "words")
    by_octave = sorted(((r["octave"], r["count"]) for r in counted.groupBy("octave").count().collect()), reverse=True)  # 16 an octave of counts
    within = np.cumsum([n for _, n in by_octave]) <= known
    least = min((o for (o, _), inside in zip(by_octave, within, strict=True) if inside), default=1 << 30)
    top = sorted(((r["n"], bytes(r["word"]), r["bucket"]) for r in counted.filter(F.col("octave") >= least).collect()), key=lambda t: (-t[0], t[1]))
    total, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        total[r["bucket"]], kinds[r["bucket"]] = r["n"], r["kinds"]
    for n, _, b in top[:most_own]:
        total[b] -= n
        kinds[b] -= 1
    own = len(top[:most_own])
    shares = np.zeros(len(top) + 1)
    shares[own + 1 :] = [np.log((n - DISCOUNT) / total[b]) for n, _, b in top[own:]]
    unseen = np.log(np.where(kinds > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
    room = F.element_at(F.array(*[F.lit(float(DISCOUNT * max(k, 1))) for k in kinds]), F.col("bucket") + 1)
    gains = counted.filter(F.col("octave") < least).select(F.xxhash64("word").alias("hash"), F.log((F.col("n") - DISCOUNT) / room).alias("gain"))
    counts = np.zeros(IDS)
    counts[1 : own + 1] = [n for n, _, _ in top[:own]]
    counts[IDS - ENDINGS :] = total
    return Words({w: i for i, (_, w, _) in enumerate(top, start=1)}, own, shares, unseen), gains, counts


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """A written table of ``row`` (a key of each row), doc_id, ids (16 bits a word), share (sum of log shares) and far (hashes of words without a rank)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch):
                ids, share, far, sizes = own.codes(part.column("text"))
                text = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                away = np.concatenate([[0], np.cumsum(np.bincount(text[far != 0], minlength=len(sizes)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), packed, pa.array(np.bincount(text, share, len(sizes))), pa.ListArray.from_arrays(pa.array(away), pa.array(far[far != 0]))],
                    names=["doc_id", "ids", "share", "far"],
                )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = typed.mapInArrow(code, "doc_id long, ids binary, share double, far array<long>")
    return materialize(coded.withColumn("row", F.monotonically_increasing_id()), "coded")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all rows one after the other, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint16, data.size // 2)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint16)
    return ids.astype(np.int32), np.diff(ends)


def masked_in(turn: int, sizes: np.ndarray) -> np.ndarray:
    """Which words of texts of these sizes, one text after the other, a round masks."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.flatnonzero((place + np.repeat(np.arange(len(sizes)), sizes)) % MASK_ONE_IN == turn % MASK_ONE_IN)


def fit(coded: DataFrame, start_at: Params, rounds: int = 2) -> Params:
    """Parameters after so many rounds over encoded documents."""
    params = start_at
    for turn in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(params)

        def steps(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            p, seen = {k: v.copy() for k, v in shared.value.items()}, 0
            square = {k: np.full_like(v, 1e-6) for k, v in p.items()}
            for batch in batches:
                for part in text_slices(batch, "ids", ID_BYTES):
                    ids, sizes = unpacked(part.column("ids"))
                    masked = masked_in(turn, sizes)
                    around = contexts(ids, sizes)[masked]
                    for a in range(0, len(masked), BATCH):
                        for k, g in gradient(p, around[a : a + BATCH], ids[masked[a : a + BATCH]]).items():
                            square[k] += g * g
                            p[k] -= RATE / (turn + 1) * g / np.sqrt(square[k])
                    seen += len(masked)
            if seen:
                flat = pack(p) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, seen))], names=["at", "value"])

        summed = coded.select("ids").mapInArrow(steps, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        found = summed.toArrow().sort_by("at")["value"].to_numpy()  # one number a parameter
        if len(found) and found[-1] > 0:
            params = unpack(found[:-1] / found[-1])
    return params


def train(docs: DataFrame, rounds: int = 2, seed: int = 17, known: int = KNOWN, most_own: int = OWN) -> Model:
    """Model of all documents; null texts teach nothing."""
    words, gains, counts = vocabulary(docs, known, most_own)
    return Model(words, gains, fit(encode(docs, words), start(counts, seed), rounds))


def train_and_score(docs: DataFrame, rounds: int = 2, seed: int = 17) -> DataFrame:
    """``score`` of all documents by a model of them all, where texts are encoded once."""
    words, gains, counts = vocabulary(docs)
    coded = encode(docs, words)
    return rated(coded, Model(words, gains, fit(coded, start(counts, seed), rounds)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all words), mean_log_likelihood, a row for each row of docs.

    Null and blank texts have no words: 0, 0.0 and null. Repeated rows get a row each, a null doc_id is
    kept, an empty table gives no rows; other columns are ignored.
    """
    return rated(encode(docs, model.words), model)


def rated(coded: DataFrame, model: Model) -> DataFrame:
    """``score`` of encoded documents."""
    shared = coded.sparkSession.sparkContext.broadcast(model.params)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for part in text_slices(batch, "ids", ID_BYTES):
                ids, sizes = unpacked(part.column("ids"))
                around = contexts(ids, sizes)
                logs = np.concatenate([np.zeros(0), *(forward(p, around[a : a + CHUNK], ids[a : a + CHUNK])[0] for a in range(0, len(ids), CHUNK))])
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes)) + part.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes), pa.array(sums)], names=["row", "doc_id", "n_tokens", "near"])

    near = coded.select("row", "doc_id", "ids", "share").mapInArrow(rate, "row long, doc_id long, n_tokens long, near double")
    far = coded.select("row", F.explode("far").alias("hash")).join(model.gains, "hash").groupBy("row").agg(F.sum("gain").alias("gain"))
    total = F.col("near") + F.coalesce("gain", F.lit(0.0))
    return near.join(far, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood")
    )
