"""Canonical exact digest of documents.

A text is normalised (NFKC), case-folded, normalised again, and its white space folded; its digest is
the 128-bit xxh3 hash of the result. Inside every bucket of equal digests the canonical bytes are
compared with those of the bucket's first document; a text that differs there gets a digest of its
own, so equal digests mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rows of a range of doc_ids, and how many ranges at most; a range is streamed, never held whole.
DOCS_A_PART, MOST_PARTS = 1500, 20_000
#: Rows in buckets of two or more up to which their ids are sent to the texts (about 60 bytes a row); beyond, both are shuffled.
BROADCAST_MEMBERS = 1_000_000


def canonical(text: str | None) -> str:
    """NFKC, case folding, NFKC again, runs of white space to one blank, none at the ends. Null is empty."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def digest_of(canon: str) -> bytes:
    return xxhash.xxh3_128_digest(canon.encode("utf-8", "surrogatepass"))


def digest(text: str | None) -> str:
    return digest_of(canonical(text)).hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _canonical_bytes(column: str = "text"):
    @F.pandas_udf("binary")
    def bytes_of(texts):
        return texts.map(lambda t: canonical(t).encode("utf-8", "surrogatepass"))

    return bytes_of(column)


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and row_key, which tells apart the texts of rows that share a doc_id, or have none, by a 64-bit hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("row_key", F.xxhash64("text"))


def resolve_collisions(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """keyed with the fingerprints of colliding texts told apart, and copy_of: as many rows, its other columns kept.

    keyed: doc_id, row_key, fingerprint and more; texts: with_row_key(). copy_of is the smallest doc_id of the bucket (null if none has
    one). Only rows of buckets with two or more rows bring their texts, repeated ones once; each is compared with the bucket's first, so
    a bucket of any size stays spread out (the join splits its partitions where a bucket is large).
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key"))
    buckets = keyed.groupBy("fingerprint").agg(first.alias("_first"), F.count("*").alias("_rows"))
    joined = keyed.join(buckets, "fingerprint")
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("row_key") == F.col("_first.row_key"))
    members = joined.filter("_rows > 1").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "fingerprint", is_first.alias("is_first")).distinct()
    few = members.count() <= BROADCAST_MEMBERS
    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
    told = texts.join(F.broadcast(members) if few else members, same_row)
    with_text = told.groupBy("_id", "_key", "fingerprint", "is_first").agg(F.min("text").alias("text")).withColumn("canon", _canonical_bytes())
    heads = with_text.filter("is_first").select("fingerprint", F.col("canon").alias("head"))
    differs = with_text.join(heads, "fingerprint").filter("canon != head")
    other = differs.select("_id", "_key", F.substring(F.sha2("canon", 256), 1, 32).alias("_other"))
    named = joined.join(other, same_row, "left").withColumns(
        {"fingerprint": F.coalesce("_other", "fingerprint"), "copy_of": F.when(F.col("_other").isNull(), F.col("_first.doc_id"))}
    )
    return named.select(*keyed.columns, "copy_of")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, copy_of (smallest doc_id with the same canonical text), a row for each row.

    Null text counts as empty; repeated rows, rows that share a doc_id and rows without one have a row each.
    """
    own = with_row_key(docs)
    one = F.pandas_udf(lambda texts: texts.map(digest), "string")
    return resolve_collisions(own.select("doc_id", "row_key", one("text").alias("fingerprint")), own).drop("row_key")


def _part_bounds(ids: DataFrame) -> list[int]:
    """doc_ids that cut the table into parts of about DOCS_A_PART rows, MOST_PARTS at most."""
    parts = min(MOST_PARTS, ids.count() // DOCS_A_PART)
    if parts < 2:
        return []
    return sorted(set(ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]))


EDITED_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
EDITED_DDL = "doc_id long, row_key long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _edit_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, lent, doc_id, text); a part ends with a row that only lends its text. One row is held back until the next is seen."""
    held: tuple[int, int | None, int, str, str] | None = None  # part, doc_id, row_key, text, canonical text
    for batch in batches:
        out: list[tuple] = []
        for part, lent, doc_id, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = canonical(text)
            if held is not None and held[0] == part:
                _, held_id, held_key, held_text, held_canon = held
                new = edited(held_text, text)
                new_canon = canonical(new)
                sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest()
                out.append((held_id, held_key, len(held_text), sha, digest_of(held_canon), digest_of(new_canon), float(held_canon == new_canon), float(held_canon == own)))
            held = None if lent else (part, doc_id, key, text, own)
        columns = list(zip(*out, strict=True)) or [()] * len(EDITED_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDITED_SCHEMA, strict=True)], schema=EDITED_SCHEMA)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, copy_of.

    A row for each row. The next document is the one with the next doc_id; rows that share one follow each other by text, rows
    without one come last, also by text; after the last comes the first (a sole document is its own next). Parts of the table are
    ranges of doc_id; the first document of each is also lent to the part before, so a text moves once. Exact digests are alike (1.0)
    or not (0.0), by comparison of the canonical texts. Null text is empty; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = with_row_key(docs)
    cuts = _part_bounds(texts.select("doc_id").filter("doc_id is not null"))
    edges = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))
    range_of = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(edges.value, ids.to_numpy(), side="right"), dtype="int32"), "int")
    # Rows without a doc_id are a part of their own, after all others.
    part_of = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(range_of(F.coalesce("doc_id", F.lit(0).cast("long"))))
    parts = texts.select("doc_id").withColumn("part", part_of).groupBy("part").agg(F.min("doc_id").alias("first"))
    firsts = sorted((r["part"], r["first"]) for r in parts.collect())  # one row a part
    lend = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    lend_df = spark.createDataFrame(lend, "first long, part int")
    own = texts.select(part_of.alias("part"), F.lit(0).alias("lent"), "doc_id", "text", "row_key")
    lent = texts.join(F.broadcast(lend_df), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    rows = own.union(lent.select("part", F.lit(1).alias("lent"), "doc_id", "text", F.lit(0).cast("long").alias("row_key")))
    in_order = rows.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "lent", "doc_id", "text")
    made = materialize(in_order.mapInArrow(_edit_part, EDITED_DDL), "digests")
    return resolve_collisions(made.withColumn("fingerprint", F.lower(F.hex("fingerprint"))), texts).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        "fingerprint",
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "copy_of",
    )
