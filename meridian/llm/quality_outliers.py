"""Quality rules: robust multivariate outliers among text statistics, with Spark expressions alone.

Every document gets a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate of location and scatter is found by concentration steps from several
deterministic starts; a document is rejected when its Mahalanobis distance under its group's estimate
is too large. All steps aggregate moments of the whole group (combined before the shuffle); no group
is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, fresh, materialize, shared_dir, split_words

SYMBOLS = "#*$%&|<>"  # fixed values


def text_stats(docs: DataFrame) -> DataFrame:
    """docs' columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, without its text.

    Null text counts as empty. Every step is a projection over one row, so the texts never move. Windows
    of three words are compared by 64-bit hashes, within one text only.
    """
    kept = [c for c in docs.columns if c != "text"]
    whole = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    # Each projection uses what the one before made more than once, so Spark keeps them apart.
    split = docs.select(*kept, split_words(F.col("text")).alias("_words"), lines.alias("_lines"), F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    at = lambda k: F.get("_words", k)
    windows = F.when(
        F.size("_words") >= 3,
        F.sort_array(F.transform(F.slice("_words", F.lit(1), F.size("_words") - 2), lambda w, i: F.struct(F.xxhash64(w, at(i + 1), at(i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    counted = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Equal windows lie side by side; their positions, in order, cover up to three words each.
    hash_at = lambda k: F.get("_windows", k)["h"]
    found_twice = F.filter("_windows", lambda s, k: F.coalesce(hash_at(k + 1) == s["h"], F.lit(False)) | F.coalesce(hash_at(k - 1) == s["h"], F.lit(False)))
    stats = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    placed = counted.select(*stats, F.sort_array(F.transform(found_twice, lambda s: s["i"])).alias("_twice"))
    covered = F.aggregate(
        F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return placed.select(*stats, covered.cast("long").alias("n_repeat_words"))

#: Transformed statistics, and the least spread that counts as real in each: below it all texts look alike.
FEATURES = {
    "log_words": 0.25,
    "log_word_length": 0.05,
    "log_symbol_percent": 0.1,
    "log_dup_lines": 0.5,
    "angle_of_repeats": 0.15,
}
P = len(FEATURES)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
X, M = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)]
#: Distances are binned on a logarithmic scale to find the h nearest documents of a group; bins an octave.
BINS_AN_OCTAVE = 16
#: Groups up to which estimates (about 400 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: An estimate of n documents counts n parts, that of the group above it so many.
PARENT_PARTS = 50


#: Squared distance beyond which a document is rejected.
CUTOFF = 100.0


def feature_columns() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words")),
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.log1p(F.col("n_dup_lines")),
        F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))),
    ]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


S, W = [f"s{i}{j}" for i, j in LOWER], [f"w{i}{j}" for i, j in LOWER]


def _floored(scatter: DataFrame) -> DataFrame:
    """Adds the least spreads to the diagonal of s_ij, which makes every scatter matrix positive definite."""
    return scatter.withColumns({f"s{i}{i}": F.col(f"s{i}{i}") + F.lit(least**2) for i, least in enumerate(FEATURES.values())})


def _whitened(scatter: DataFrame, keep: list[str]) -> DataFrame:
    """keep, s_ij, w_ij (inverse of the lower Cholesky factor) and logdet, from columns s_ij of a positive definite matrix."""
    df = scatter.select(*keep, *S)
    for j in range(P):
        low = lambda i, j=j: F.col(f"s{i}{j}") - _total([F.lit(0.0)] + [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)])
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(low(j), F.lit(1e-12))))
        df = df.withColumns({f"l{i}{j}": low(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        df = df.withColumns(
            {f"w{i}{j}": (F.lit(1.0) if i == j else -_total([F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)])) / F.col(f"l{i}{i}") for j in range(i + 1)}
        )
    logdet = _total([2 * F.log(f"l{i}{i}") for i in range(P)])
    return df.select(*keep, *S, *W, logdet.alias("logdet"))


def _beside(estimates: DataFrame) -> DataFrame:
    """estimates, to be broadcast if they are few."""
    return F.broadcast(estimates) if estimates.count() <= BROADCAST_GROUPS else estimates


def _distance() -> Column:
    """Squared Mahalanobis distance of x under m and w."""
    return _total([F.pow(_total([F.col(f"w{i}{k}") * (F.col(X[k]) - F.col(M[k])) for k in range(i + 1)]), F.lit(2.0)) for i in range(P)])


def _starts(vectors: DataFrame) -> DataFrame:
    """group, start, m, w, logdet: three deterministic first estimates for each group.

    All lie at the coordinatewise median. Scatter: the squared median absolute deviations; the
    covariance of hyperbolic tangents; that of spatial signs.
    """
    floors = list(FEATURES.values())
    medians = vectors.groupBy("group").agg(*[F.percentile_approx(x, 0.5, 1000).alias(m) for x, m in zip(X, M, strict=True)]).checkpoint()
    spreads = vectors.join(_beside(medians), "group").groupBy("group", *M).agg(
        *[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(X[i]) - F.col(M[i])), 0.5, 1000), F.lit(floors[i])).alias(f"d{i}") for i in range(P)]
    )
    spreads = spreads.checkpoint()
    z = vectors.join(_beside(spreads), "group").select("group", *[((F.col(X[i]) - F.col(M[i])) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)])
    norm = F.sqrt(_total([F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]) + 1e-9)
    sums = z.withColumn("norm", norm).groupBy("group").agg(
        *[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in LOWER],
        *[(P * F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") / F.col("norm"))).alias(f"u{i}{j}") for i, j in LOWER],
    )
    kinds = spreads.join(sums, "group").withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    scatter = {
        f"s{i}{j}": F.when(F.col("start") == 0, float(i == j)).when(F.col("start") == 1, F.col(f"t{i}{j}")).otherwise(F.col(f"u{i}{j}")) * F.col(f"d{i}") * F.col(f"d{j}")
        for i, j in LOWER
    }
    return _whitened(_floored(kinds.withColumns(scatter)), ["group", "start", *M])


def _concentrate(vectors: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step: mean and covariance of the share of each group that is nearest under params.

    Moments are summed by bin of distance, so a group counts as many rows as it has bins; of the bin in
    which the share ends, as much counts as it needs.
    """
    bins = F.floor(BINS_AN_OCTAVE * F.log2(_distance() + 1e-3)).cast("int")
    near = vectors.join(_beside(params.drop("logdet", *S)), "group").withColumn("bin", bins)
    delta = [F.col(X[i]) - F.col(M[i]) for i in range(P)]
    binned = near.groupBy("group", "start", *M, "bin").agg(
        F.count("*").alias("n"),
        *[F.sum(delta[i]).alias(f"a{i}") for i in range(P)],
        *[F.sum(delta[i] * delta[j]).alias(f"q{i}{j}") for i, j in LOWER],
    )
    of_group = Window.partitionBy("group", "start")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("all") * share - F.col("before")
    subset = binned.withColumns({"before": before, "all": F.sum("n").over(of_group)}).withColumn("part", F.least(F.lit(1.0), room / F.col("n"))).filter("part > 0")
    summed = lambda c: F.sum(F.col("part") * F.col(c)).alias(c)
    sums = subset.groupBy("group", "start", *M).agg(summed("n"), *[summed(f"a{i}") for i in range(P)], *[summed(f"q{i}{j}") for i, j in LOWER])
    moved = sums.select(
        "group",
        "start",
        *[(F.col(M[i]) + F.col(f"a{i}") / F.col("n")).alias(M[i]) for i in range(P)],
        *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("n") / F.col("n")).alias(f"s{i}{j}") for i, j in LOWER],
    )
    return _whitened(_floored(moved), ["group", "start", *M])


def minimum_covariance(vectors: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """group, m, s, w: of the starts of each group the one whose scatter ends with the least determinant."""
    shared_dir(vectors.sparkSession)
    params = _starts(vectors).checkpoint()
    for _ in range(steps):
        params = _concentrate(vectors, params, share).checkpoint()
    best = params.groupBy("group").agg(F.min(F.struct("logdet", "start")).alias("best"))
    kept = params.join(best, "group").filter(F.col("start") == F.col("best.start"))
    return kept.select("group", *M, *S, *W).checkpoint()


def _pooled(own: DataFrame, above: DataFrame) -> DataFrame:
    """group, n, m and s of own (group, parent, n, m, s), mixed with those of the parent: n parts of its own, PARENT_PARTS of the parent's.

    Mean and covariance of the mixture, so a group of any size goes over into its parent without a break.
    """
    names = {c: f"{c}_up" for c in (*M, *S)}
    both = own.join(above.select(F.col("group").alias("parent"), *[F.col(c).alias(up) for c, up in names.items()]), "parent")
    part = F.col("n") / (F.col("n") + PARENT_PARTS)
    mixed = lambda c: part * F.col(c) + (1 - part) * F.col(names[c])
    apart = [F.col(m) - F.col(names[m]) for m in M]
    scatter = [(mixed(f"s{i}{j}") + part * (1 - part) * apart[i] * apart[j]).alias(f"s{i}{j}") for i, j in LOWER]
    return both.select("group", "n", *[mixed(m).alias(m) for m in M], *scatter)


def estimates(good: DataFrame, share: float, steps: int) -> DataFrame:
    """group, m, w for each language and source of good (fine, coarse, x): its own estimate, that of its language and that of all mixed."""
    tables = Tables(good.sparkSession)
    levels = F.array("fine", "coarse", F.lit(""))
    vectors = tables.write(good.select(F.explode(levels).alias("group"), *X), "vectors")
    found = minimum_covariance(vectors, share, steps)
    sized = found.join(vectors.groupBy("group").agg(F.count("*").alias("n")), "group").checkpoint()
    tables.drop()
    parents = good.select(F.col("fine").alias("group"), F.col("coarse").alias("parent")).distinct()
    tops = parents.select(F.col("parent").alias("group"), F.lit("").alias("parent")).distinct()
    coarse = _pooled(sized.join(tops, "group"), sized)
    return _whitened(_pooled(sized.join(parents, "group"), coarse), ["group", *M]).select("group", *M, *W).checkpoint()


def _judged(docs: DataFrame, cutoff: float, share: float, steps: int) -> DataFrame:
    """judge() with ``key``, a hash of what the verdict hangs on."""
    shared_dir(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    measured = text_stats(docs.select("doc_id", "text", "lang", "source").withColumn("key", F.xxhash64("text", "lang", "source")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(measured.withColumn("base_failed", failed), "stats")
    names = {"fine": F.to_json(F.struct("lang", "source")), "coarse": F.to_json(F.struct(F.col("lang").alias("all_of")))}
    vectors = stats.withColumns(names).withColumns(dict(zip(X, feature_columns(), strict=True)))
    good = tables.write(vectors.filter(~F.col("base_failed")).select("fine", "coarse", *X), "good")
    params = estimates(good, share, steps)
    tables.drop()
    scored = vectors.join(_beside(params.withColumnRenamed("group", "fine")), "fine", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return scored.select(*stats.columns, F.coalesce(kept, F.lit(False)).alias("kept"), "distance")


def judge(docs: DataFrame, cutoff: float = CUTOFF, share: float = 0.75, steps: int = 5) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A document fails the base rules with under 50 words, or with over half of its words in repeated
    windows of three; the rest is kept unless its squared distance is over the cutoff. Null text counts
    as empty and so fails; null lang or source is a value of its own; repeated rows get a row each, a
    null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    return _judged(docs, cutoff, share, steps).drop("key")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, share: float = 0.75, steps: int = 5) -> DataFrame:
    """docs, row by row, without the rejected ones; all columns kept, whatever their names."""
    doc_id, key = fresh(docs, "judged_id", "judged_key")
    good = _judged(docs, cutoff, share, steps).filter("kept").select(F.col("doc_id").alias(doc_id), F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text", "lang", "source"))
    # Rows without a doc_id go by their key alone.
    same = keyed["doc_id"].eqNullSafe(good[doc_id]) & (keyed[key] == good[key])
    return keyed.join(good, same, "left_semi").select(*docs.columns)
