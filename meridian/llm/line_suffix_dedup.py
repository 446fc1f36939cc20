"""Line dedup by a suffix array over line ids, with DataFrame operations alone.

A document is the sequence of its lines' ids. Prefix doubling ranks its suffixes: the rank of a suffix
by its first 2 ** (k + 1) lines is the rank of the pair of its own rank and that of the suffix 2 ** k
lines on, both by 2 ** k lines. Pairs are ranked by sorting them over the cluster by range, so a rank
is a place in the suffix array; a suffix whose pair occurs once is in no repeated run and leaves.

Suffixes that share their first n lines are an interval of the suffix array whose longest common
prefixes are n or more. With 2 ** k <= n < 2 ** (k + 1), the interval of a suffix is told by two ranks
at level k: its own and that of the suffix n - 2 ** k lines on, as the two blocks cover all n lines.
In every interval the first occurrence in the corpus stays; the others are later copies.

Which n a suffix is asked for hangs on its lines alone: from the least number of lines with ``min_chars``
characters to the greatest for which the lines after the first have fewer. Every line of a repeated run of
``min_chars`` characters lies in one of these: the shortest that begins with it, the shortest that ends with it, or,
where the run has too few characters on either side, the shortest that begins where the run does. So the
copies, joined where they overlap, are the maximal repeated runs to their last line. They are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, fresh, materialize

DOC = ["_doc", "_hash"]
NO_ID = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _least_run(sizes: str, i: Column, size: Column, min_chars: int) -> Column:
    """How many lines from line i on have min_chars characters (line ends count); null if the rest has fewer."""

    def within(most: int) -> Column:
        grown = F.aggregate(
            F.slice(sizes, i + 1, F.lit(most)),
            F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")),
            lambda acc, x: F.when(acc["chars"] >= min_chars, acc).otherwise(F.struct((acc["chars"] + x).alias("chars"), (acc["n"] + 1).alias("n"))),
        )
        return F.when(grown["chars"] >= min_chars, grown["n"])

    # A line counts one character at least, so min_chars lines always do.
    return F.when(size >= min_chars, F.lit(1)).otherwise(F.coalesce(within(4), within(min_chars)))


def line_ids(docs: DataFrame, min_chars: int) -> DataFrame:
    """_doc, _hash, pos, h, g (two independent hashes of the line: its id), m and upto (lengths, in lines, of the runs that begin
    here and are asked for), a row for each line."""
    names = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_hash")]
    keyed = docs.select(*names, _lines(F.col("text")).alias("lines"))
    sized = keyed.select(*DOC, "lines", F.transform("lines", lambda x: F.length(x) + 1).alias("sizes"))
    least = sized.withColumn("least", F.transform("sizes", lambda x, i: _least_run("sizes", i, x, min_chars)))
    # Where no run begins at the next line, those from this one go on to the end.
    most = lambda i, m: F.when(m.isNotNull(), F.greatest(m, F.coalesce(F.get("least", i + 1), F.size("lines") - i)))
    ids = F.transform(
        "lines",
        lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), F.get("least", i).alias("m"), most(i, F.get("least", i)).alias("upto")),
    )
    return least.select(*DOC, F.posexplode(ids).alias("pos", "id")).select(*DOC, "pos", "id.h", "id.g", "id.m", "id.upto")


def _ranks(keys: DataFrame, by: list[str]) -> DataFrame:
    """Ranks, in order, of the keys that occur twice or more: places after a sort by range over the cluster."""
    often = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    in_order = often.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(in_order.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _with_next(suffixes: DataFrame, ranked: DataFrame, offset: Column, name: str) -> DataFrame:
    """suffixes with the rank of the suffix offset lines on, where that is in a repeated run too."""
    on = ranked.select(*DOC, F.col("pos").alias("_at"), F.col("rank").alias(name))
    return suffixes.withColumn("_at", (F.col("pos") + offset).cast("int")).join(on, [*DOC, "_at"]).drop("_at")


def repeated_runs(docs: DataFrame, min_chars: int = 160) -> DataFrame:
    """_doc, _hash, start, end: the maximal runs of lines that are later copies, as half-open ranges of line numbers."""
    ids = line_ids(docs, min_chars)
    ranked = materialize(ids.join(_ranks(ids, ["h", "g"]), ["h", "g"]).select(*DOC, "pos", "m", "upto", "rank").dropDuplicates([*DOC, "pos"]), "suffixes")
    longest = ranked.agg(F.max("upto")).first()[0] or 1
    intervals, k = [], 0
    while True:
        most = F.least(F.col("upto"), F.lit(2 ** (k + 1) - 1))
        asked = ranked.filter((F.col("upto") >= 2**k) & (F.col("m") < 2 ** (k + 1))).withColumn("m", F.explode(F.sequence(F.greatest("m", F.lit(2**k)), most)))
        here = asked.select(*DOC, "pos", "m", "rank")
        exact = here.filter(F.col("m") == 2**k).withColumn("other", F.col("rank"))
        if k:
            longer = here.filter(F.col("m") > 2**k)
            exact = exact.union(_with_next(longer, ranked, F.col("m") - 2**k, "other").select(exact.columns))
        intervals.append(exact.withColumn("level", F.lit(k)))
        if 2 ** (k + 1) > longest:
            break
        paired = _with_next(ranked, ranked, F.lit(2**k), "next").withColumnRenamed("rank", "first")
        ranks = _ranks(paired, ["first", "next"])
        ranked = materialize(paired.join(ranks, ["first", "next"]).select(*DOC, "pos", "m", "upto", "rank"), "suffixes")
        k += 1
    return _merged(reduce(DataFrame.union, intervals))


def _merged(found: DataFrame) -> DataFrame:
    """Maximal runs out of the intervals (level, m, rank, other) of all suffixes: what is not first, joined where it overlaps."""
    key = ["level", "m", "rank", "other"]
    heads = found.groupBy(*key).agg(F.min(F.struct(*DOC, "pos")).alias("head"))
    copies = found.join(heads, key).filter(F.struct(*DOC, "pos") != F.col("head")).select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("m")).alias("end"))
    order = Window.partitionBy(*DOC).orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def dedup_lines(docs: DataFrame, min_chars: int = 160) -> DataFrame:
    """docs, all columns kept, with the text that is left, and line_count and lines_deleted.

    A run of whole lines with min_chars characters or more (line ends counted) is deleted where the same
    run stands earlier in the corpus, by doc_id and line; runs may overlap and repeat in one document.
    Null text has no lines deleted and stays null; null doc_ids come first; rows that share both doc_id
    and text are one document and lose the same lines; an empty table gives no rows. Columns of docs
    called like the new ones are replaced; the text becomes empty where all lines go.
    """
    columns = [c for c in docs.columns if c not in ("line_count", "lines_deleted")]
    rest = docs.select(*columns)
    doc, hash_, found, lines = fresh(rest, *DOC, "_runs", "_lines")
    runs = repeated_runs(docs, min_chars).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end")))).toDF(doc, hash_, found)
    keyed = rest.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), hash_: F.xxhash64("text")})
    joined = keyed.join(runs, [doc, hash_], "left").withColumn(lines, _lines(F.col("text")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"])
    kept = F.flatten(F.transform(found, lambda r, i: F.slice(lines, before(i) + 1, r["start"] - before(i))))
    end = F.element_at(found, -1)["end"]
    left = F.array_join(F.concat(kept, F.slice(lines, end + 1, F.size(lines))), "\n")
    deleted = F.aggregate(found, F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    return joined.select(
        *[F.when(F.col(found).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else c for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("line_count"),
        F.coalesce(deleted, F.lit(0)).alias("lines_deleted"),
    )


def drop_emptied(deduped: DataFrame) -> DataFrame:
    """Without the documents of which the deletion left no word; n_chars, where there is one, follows the text."""
    left = deduped.filter((F.col("lines_deleted") == 0) | (F.btrim("text", F.lit(SPACES)) != "")).drop("line_count", "lines_deleted")
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left
