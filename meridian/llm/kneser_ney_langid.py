"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order four over an alphabet of classes: 0 for all that is no letter, one for
each letter of the training texts, whatever its script, and one for letters that these lack. Every
n-gram of the training texts counts: probabilities are derived in Spark, order by order, and only the
finished ones come to the driver, as sorted arrays of n-grams with an entry for each language that has
one. A text gets the language with the lowest cross-entropy a character; the margin to the second is
turned into a score by a logistic curve fitted on documents that the counts leave out, and a
cross-entropy far above theirs marks the answer as unreliable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ragged, small_batches, text_slices

#: Four classes fill 60 bits; 32,766 letters have one of their own, by frequency, which is more than any script has in use.
ORDER, BITS = 4, 15
CLASSES = 1 << BITS
DISCOUNT = 0.75
#: Bound: about so many documents for the calibration, and about one in so many of a language at most.
CALIBRATION_DOCS, CALIBRATE_ONE_IN = 1_000, 10
#: Bytes of text scored at a time; n-grams whose probabilities a task remembers.
SLICE, REMEMBERED = 1 << 20, 2_000_000


@dataclass
class Table:
    """Values of n-grams by language: sorted n-grams, and where the entries of each start."""

    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    values: np.ndarray
    missing: float
    width: int

    @classmethod
    def of(cls, lang: np.ndarray, codes: np.ndarray, values: np.ndarray, missing: float, width: int) -> Table:
        order = np.argsort(codes)
        keys, starts = np.unique(codes[order], return_index=True)
        return cls(keys, np.append(starts, len(codes)), lang[order].astype(np.int32), values[order].astype(np.float64), missing, width)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = np.full((len(codes), self.width), self.missing)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == codes)
            sizes = self.starts[at[hit] + 1] - self.starts[at[hit]]
            rows = ragged(self.starts[at[hit]], sizes)
            out[np.repeat(hit, sizes), self.lang[rows]] = self.values[rows]
        return out


@dataclass
class Model:
    langs: list[str]
    letters: list[str]
    unigrams: np.ndarray  # class by language
    grams: list[Table]  # orders 2, 3, ...: discounted probabilities
    backoff: list[Table]  # by context, for the same orders
    slope: float = 8.0
    offset: float = 0.0
    worst: float = 99.0

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithms of the interpolated probabilities of n-grams, by language."""
        p = self.unigrams[codes & (CLASSES - 1)]
        for n, (gram, back) in enumerate(zip(self.grams, self.backoff, strict=True), start=2):
            own = codes & ((1 << (BITS * n)) - 1)
            p = gram(own) + back(own >> BITS) * p
        return np.log(p).astype(np.float32)


def class_table(letters: list[str]) -> np.ndarray:
    """Class of every code point."""
    table = np.array([CLASSES - 1 if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.int64)
    place = {x: i + 1 for i, x in enumerate(letters)}
    for c in np.flatnonzero(table).tolist():
        table[c] = place.get(chr(c).lower(), CLASSES - 1)
    return table


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def gram_codes(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character, the text of each, and the letters of each text.

    Texts start after blanks; of a run of characters that are no letters the first counts.
    """
    points, sizes = _code_points(texts)
    own = classes[points]
    starts = np.cumsum(sizes) - sizes
    pad = ORDER - 1
    at = np.arange(len(own)) + np.repeat(np.arange(1, len(texts) + 1) * pad, sizes)
    padded = np.zeros(len(own) + pad * len(texts), np.int64)
    padded[at] = own
    code = padded[at]
    for k in range(1, ORDER):
        code = code | (padded[at - k] << (BITS * k))
    keep = (code & ((1 << 2 * BITS) - 1)) != 0
    letters = np.add.reduceat(np.append(own > 0, False).astype(np.int64), np.minimum(starts, len(own)))
    letters[sizes == 0] = 0
    return code[keep], np.repeat(np.arange(len(texts)), sizes)[keep], letters


def _letters(training: DataFrame) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                points, n = np.unique(_code_points(part.column("text").to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n)], names=["point", "n"])

    counted = training.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    totals: dict[str, int] = {}
    for row in counted.collect():  # code points, so 1.1 million at most
        low = chr(row["point"]).lower()
        if chr(row["point"]).isalpha():
            totals[low] = totals.get(low, 0) + row["n"]
    return sorted(totals, key=lambda x: (-totals[x], x))[: CLASSES - 2]


def _grouped(lang: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of language and code, ascending, and which of them each row has."""
    codes, place = np.unique(code, return_inverse=True)
    pairs, of = np.unique(lang * len(codes) + place, return_inverse=True)
    return pairs // max(len(codes), 1), codes[pairs % max(len(codes), 1)], of


def _counts(training: DataFrame, letters: list[str], langs: list[str]) -> DataFrame:
    """lang (its index), code and n, the count, of every n-gram of the highest order."""
    shared = training.sparkSession.sparkContext.broadcast((class_table(letters), {x: i for i, x in enumerate(langs)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, place = shared.value
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                code, text, _ = gram_codes(part.column("text").to_pylist(), classes)
                own = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                lang, grams, of = _grouped(own[text], code)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(grams), pa.array(np.bincount(of, minlength=len(grams)))], names=["lang", "code", "n"])

    return training.mapInArrow(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _low(code: Column, order: int) -> Column:
    """The last classes of n-grams."""
    return code.bitwiseAND(F.lit((1 << BITS * order) - 1).cast("long"))


def _unigrams(lang: np.ndarray, code: np.ndarray, n: np.ndarray, width: int, letters: int) -> np.ndarray:
    """What is discounted goes to all letters, non-letters and unknown letters alike."""
    counts = np.zeros((CLASSES, width))
    counts[code, lang] = n
    total = np.maximum(counts.sum(axis=0), 1)
    spare = np.where(counts.sum(axis=0) > 0, DISCOUNT * (counts > 0).sum(axis=0) / total, 1.0)
    return np.maximum(counts - DISCOUNT, 0) / total + spare / (letters + 2)


def fit(lang: np.ndarray, code: np.ndarray, n: np.ndarray, langs: list[str], letters: list[str]) -> Model:
    """Interpolated Kneser-Ney: counts at the highest order, numbers of distinct left extensions below.

    For counts that are in memory; fit_all() does the same over a DataFrame.
    """
    grams, backoff = [], []
    for order in range(ORDER, 1, -1):
        context_lang, contexts, of = _grouped(lang, code >> BITS)
        total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
        grams.insert(0, Table.of(lang, code, np.maximum(n - DISCOUNT, 0) / total[of], 0.0, len(langs)))
        backoff.insert(0, Table.of(context_lang, contexts, DISCOUNT * kinds / total, 1.0, len(langs)))
        lang, code, of = _grouped(lang, code & ((1 << BITS * (order - 1)) - 1))
        n = np.bincount(of, minlength=len(code))
    return Model(langs, letters, _unigrams(lang, code, n, len(langs), len(letters)), grams, backoff)


def fit_all(counts: DataFrame, langs: list[str], letters: list[str]) -> Model:
    """fit() over all n-grams of counts (lang, code, n), with counts, totals and discounts worked out in Spark."""

    def arrays(df: DataFrame) -> list[np.ndarray]:
        return [column.to_numpy() for column in df.toArrow().columns]

    grams, backoff, level = [], [], materialize(counts, "grams")
    for order in range(ORDER, 1, -1):
        keyed = level.withColumn("context", F.shiftright("code", BITS))
        contexts = keyed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        grams.insert(0, Table.of(*arrays(keyed.join(contexts, ["lang", "context"]).select("lang", "code", share.alias("p"))), 0.0, len(langs)))
        backoff.insert(0, Table.of(*arrays(contexts.select("lang", "context", (DISCOUNT * F.col("kinds") / F.col("total")).alias("p"))), 1.0, len(langs)))
        level = level.groupBy("lang", _low(F.col("code"), order - 1).alias("code")).agg(F.count("*").alias("n"))
    return Model(langs, letters, _unigrams(*arrays(level), len(langs), len(letters)), grams, backoff)


class Scorer:
    """Cross-entropies of texts; n-grams that were met before are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.classes = model, class_table(model.letters)
        self.codes, self.known = np.zeros(0, np.int64), np.zeros((0, len(model.langs)), np.float32)

    def _log_probs(self, codes: np.ndarray) -> np.ndarray:
        """model.log_probs() of ascending codes."""
        if len(self.codes) > REMEMBERED:
            self.codes, self.known = self.codes[:0], self.known[:0]
        at = np.searchsorted(self.codes, codes)
        met = np.append(self.codes, -1)[np.minimum(at, len(self.codes))] == codes
        if not met.all():
            new = codes[~met]
            self.known = np.insert(self.known, at[~met], self.model.log_probs(new), axis=0)
            self.codes = np.insert(self.codes, at[~met], new)
            at = np.searchsorted(self.codes, codes)
        return self.known[at]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character by text and language, and the letters of each text."""
        code, text, letters = gram_codes(texts, self.classes)
        own, rows = np.unique(code, return_inverse=True)
        logs = self._log_probs(own)
        sums = np.zeros((len(texts), len(self.model.langs)))
        sizes = np.bincount(text, minlength=len(texts))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            for i in range(len(self.model.langs)):
                sums[some, i] = np.add.reduceat(logs[:, i][rows].astype(np.float64), starts)
        return -sums / np.maximum(sizes, 1)[:, None], letters


def _calibrate(model: Model, margin: np.ndarray, best: np.ndarray, right: np.ndarray) -> None:
    """Logistic curve from margin to the chance of being right, and the cross-entropy beyond which none is reliable."""
    if not len(margin) or len(model.langs) < 2:
        return
    w = np.array([model.slope, model.offset])
    for _ in range(50):  # Newton steps with a weak prior, so that perfect answers give a finite slope
        p = 1 / (1 + np.exp(-np.clip(w[0] * margin + w[1], -30, 30)))
        x = np.stack([margin, np.ones_like(margin)])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.05 * np.eye(2), x @ (right - p) - 0.05 * (w - [8.0, 0.0]))
        w = w + np.clip(step, -5, 5)
    model.slope, model.offset = float(max(w[0], 0.0)), float(w[1])
    model.worst = float(np.quantile(best, 0.999) * 1.25)


def train(docs: DataFrame) -> Model:
    """Model from the text and lang of docs; rows without either teach nothing."""
    with small_batches(docs.sparkSession, 1000):
        training = docs.select("text", "lang", F.xxhash64("text").alias("key")).filter("text is not null and lang is not null")
        letters = _letters(training)
        # Texts with small hashes are for the calibration alone; only numbers come to the driver.
        sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}  # one row a language
        langs = sorted(sizes)
        share = {x: 0.0 if n < CALIBRATE_ONE_IN else min(1 / CALIBRATE_ONE_IN, CALIBRATION_DOCS / len(sizes) / n) for x, n in sizes.items()}
        shares = F.create_map(*[F.lit(x) for kv in share.items() for x in kv]) if share else F.lit(None).cast("map<string,double>")
        apart = F.pmod("key", F.lit(1 << 40)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0)) * (1 << 40)
        kept, sample = training.filter(~apart), training.filter(apart)
        model = fit_all(_counts(kept.drop("key"), letters, langs), langs, letters)
        margins = predict(sample.select(F.lit(0).alias("doc_id"), "text", "lang"), model, "lang").filter("lang_pred != 'und'").select("margin", "cross_entropy", (F.col("lang_pred") == F.col("lang")).cast("double").alias("right"))
        _calibrate(model, *(c.to_numpy().astype(np.float64) for c in margins.toArrow().columns))
    return model


def predict(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, reliable, margin, and the string columns more, for every row of docs (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the
    language that comes first by name; repeated rows get a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = np.array([*shared.value.langs, "und"], dtype=object)
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                entropy, letters = scorer(pc.fill_null(part.column("text"), "").to_pylist())
                known = (letters > 0) & (len(langs) > 1)
                best = np.where(known, entropy.argmin(axis=1) if len(langs) > 1 else 0, len(langs) - 1)
                ranked = np.sort(np.column_stack([entropy, np.full((len(entropy), 2), 99.0)]), axis=1)
                margin = ranked[:, 1] - ranked[:, 0]
                chance = 1 / (1 + np.exp(-np.clip(shared.value.slope * margin + shared.value.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(np.where(known, chance, 0.0)), pa.array(ranked[:, 0]),
                        pa.array(known & (ranked[:, 0] <= shared.value.worst)), pa.array(margin), *[part.column(c) for c in more],
                    ],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "reliable", "margin", *more],
                )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return typed.mapInArrow(score, "doc_id long, lang_pred string, score double, cross_entropy double, reliable boolean, margin double" + "".join(f", {c} string" for c in more))


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the doc_id as text, modulo folds; null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, reliable; learned from the other folds alone."""
    model = train(docs.filter(fold(F.col("doc_id")) != held_out))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "lang_pred", "score", "cross_entropy", "reliable")
