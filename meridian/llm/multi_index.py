"""Nearest neighbours by cosine over an inverted multi-index.

The halves of the vectors, scaled to length 1, have a codebook each, so K centroids on either side make K^2 cells.
Codebooks, and the share of the rows that a search must see, are fitted on a bounded sample. A query
walks the pairs of centroids by the sum of their squared distances, kept in a heap, until the cells seen hold
that share of the index; what is in them is ranked by the cosine of the original vectors.

Equal vectors are one entry of the index with their k + 1 smallest ids: no larger id can be among the k nearest
of anything. Queries with equal vectors search once.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, small_batches

#: Distinct vectors that codebooks are fitted on, about, and those of them that try out the share to be seen.
SAMPLE, TRIED = 16_384, 256
#: Least and most centroids a half; between, the cube root of the number of entries.
LEAST_CENTROIDS, MOST_CENTROIDS = 64, 1024
ROUNDS = 12
#: Entries, and queries, that one task compares at a time, about.
ENTRY_BLOCK, QUERY_BLOCK = 32_768, 8192
#: Queries that one task walks the cells for, about.
WALKS = 256
#: Rows of an Arrow batch: vectors are wide.
BATCH_ROWS = 2048
#: What a product of matrices may be off by; candidates so close to the last one kept are scored again.
SLACK = 1e-9


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, but for the squares of the rows."""
    return (centroids**2).sum(axis=1) - 2 * x @ centroids.T


def k_means(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k centroids of x after ROUNDS of Lloyd's steps; a centroid that nothing chooses moves to the row that is served worst."""
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        d = _distances(x, centroids)
        near = d.argmin(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        empty = np.flatnonzero(sizes == 0)
        worst = np.argsort(-(d[np.arange(len(x)), near] + (x**2).sum(axis=1)))[: len(empty)]
        centroids[empty] = x[worst]
    return centroids


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1."""
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the two halves, and the share of the entries that a search sees."""

    left: np.ndarray
    right: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(axis=1), b.argmin(axis=1)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit, half = scaled(x), x.shape[1] // 2
        return _distances(unit[:, :half], self.left), _distances(unit[:, half:], self.right)


def fit(sample: np.ndarray, centroids: int, k: int, recall: float) -> Codebooks:
    """Codebooks of a sample of distinct vectors; the share is what some of the sample's rows need to find that part of
    their k nearest in it."""
    unit, half, n = scaled(sample), sample.shape[1] // 2, len(sample)
    size = max(1, min(centroids, n // 8))
    books = Codebooks(k_means(unit[:, :half], size, 1), k_means(unit[:, half:], size, 2), 1.0)
    tried = np.arange(0, n, max(1, n // TRIED))
    near = unit[tried] @ unit.T
    near[np.arange(len(tried)), tried] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return books
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    a, b = books.cells(sample)
    da, db = books.distances(sample[tried])
    sums = da[:, a] + db[:, b]
    rank = (sums[:, None, :] <= np.take_along_axis(sums, best, axis=1)[:, :, None]).sum(axis=2)
    return Codebooks(books.left, books.right, float(np.quantile(rank, recall)) / n)


def nearest_cells(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells with the least sums of left and right distances that hold ``wanted`` entries together.

    Multi-sequence walk: a heap holds the next column of every row that is open, and a row opens when the
    one before has been entered.
    """
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    la, rb = left[by_left].tolist(), right[by_right].tolist()
    held = sizes[np.ix_(by_left, by_right)].tolist()
    heap, seen, rows, columns = [(la[0] + rb[0], 0, 0)], 0, [], []
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        if held[i][j]:
            seen += held[i][j]
            rows.append(i)
            columns.append(j)
        if j + 1 < len(rb):
            heapq.heappush(heap, (la[i] + rb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(la):
            heapq.heappush(heap, (la[i + 1] + rb[0], i + 1, 0))
    return by_left[rows], by_right[columns]


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _named(valid: DataFrame) -> DataFrame:
    """id, vec and key, a 128-bit digest of vec by which equal vectors are told."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vec"), len(batch.column("vec")[0])) + 0.0  # no negative zeros
                keys = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["id", "vec", "key"])

    return valid.mapInArrow(work, "id long, vec array<double>, key binary")


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows of q and x, pair by pair; the sums run in the same order for every pair."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(q, x) / (np.sqrt(dot(q, q)) * np.sqrt(dot(x, x)))


def _best_of_block(entries: pa.Table, queries: pa.Table, width: int, most: int) -> pa.Table:
    """For each query the ``most`` ids of a block's entries that score best, ties to the smaller id."""
    out_key, out_id, out_score = [], [], []
    if entries.num_rows and queries.num_rows:
        entries = entries.sort_by([("col", "ascending")])
        x, q = (_vectors(t.column("vec").combine_chunks(), width) for t in (entries, queries))
        col = entries.column("col").to_numpy()
        ids = entries.column("ids").combine_chunks()
        many, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
        begin = np.append(0, np.cumsum(many))[:-1]
        unit, asked = scaled(x), scaled(q)
        keys = queries.column("key").combine_chunks()
        lists = queries.column("cols").combine_chunks()
        starts, visited = np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten().to_numpy()
        width_of = int(max(col.max(), visited.max())) + 1
        seen = np.zeros((len(q), width_of), bool)
        seen[np.repeat(np.arange(len(q)), np.diff(starts)), visited] = True
        step = max(1, (4 << 20) // len(x))
        for at in range(0, len(q), step):
            near = asked[at : at + step] @ unit.T
            near[~seen[at : at + step][:, col]] = -np.inf
            cut = min(most, len(x))
            last = np.partition(near, len(x) - cut, axis=1)[:, len(x) - cut]
            r, e = np.nonzero((near >= (last - SLACK)[:, None]) & (near > -np.inf))
            score = _score(q[at + r], x[e])
            row = np.repeat(np.arange(len(r)), many[e])
            one = flat[np.arange(len(row)) - np.repeat(np.cumsum(many[e]) - many[e], many[e]) + np.repeat(begin[e], many[e])]
            order = np.lexsort((one, -score[row], r[row]))
            owner = r[row][order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            kept = order[place < most]
            out_key.append(keys.take(pa.array(at + r[row][kept])))
            out_id.append(one[kept])
            out_score.append(score[row][kept])
    keys = pa.concat_arrays(out_key).cast(pa.binary()) if out_key else pa.array([], pa.binary())
    gathered = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table({"key": keys, "id": gathered(out_id, pa.int64()), "score": gathered(out_score, pa.float64())})


def search(vectors: DataFrame, id_column: str, vector_column: str, asked: Column, k: int = 5, recall: float = 0.95) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which ``asked`` holds, ties to the smaller id.

    Every row but the query's own is a candidate; score is the cosine of the original vectors in double precision. Of
    the k nearest, ``recall`` is aimed at: the share of the index that a search sees is chosen on a sample of
    about SAMPLE distinct vectors. Where that many rows, or fewer than k, are there at all, all candidates come.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
    without an id; rows that share an id leave each other out. Repeated vectors and ties: by id. An empty table gives no rows;
    further columns are not looked at.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    kind = "array<double>"
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    sound = plain.filter("id is not null and vec is not null").filter(finite & F.exists("vec", lambda v: v != 0))
    widths = sound.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], result)
    width = widths[0].width
    # A power of two takes very large and small components to where squares are exact enough; cosines stay as they are.
    most_ = F.array_max(F.transform("vec", F.abs))
    shift = F.pow(F.lit(2.0), -F.floor(F.log2(most_)))
    sound = sound.filter(F.size("vec") == width)
    sound = sound.withColumn("vec", F.when((most_ > 1e100) | (most_ < 1e-100), F.transform("vec", lambda v: v * shift)).otherwise(F.col("vec")))

    with small_batches(spark, BATCH_ROWS):
        by_id = Window.partitionBy("key").orderBy("id")
        firsts = _named(sound.select("id", "vec")).withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
        entries = tables.write(firsts.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
        named = tables.write(_named(sound.filter("asked").select("id", "vec")), "asked")
        n = entries.count()
        drawn = entries.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, SAMPLE / n))).select("key", "vec")
        rows = sorted(drawn.collect())
        sample = np.array([r.vec for r in rows], np.float64).reshape(len(rows), width)
        if not len(sample):
            return spark.createDataFrame([], result)
        books = spark.sparkContext.broadcast(fit(sample, max(LEAST_CENTROIDS, min(MOST_CENTROIDS, round(n ** (1 / 3)))), k, recall))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    row, col = books.value.cells(_vectors(batch.column("vec"), width))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row, pa.int32()), pa.array(col, pa.int32())], names=["key", "vec", "ids", "row", "col"])

        placed = entries.mapInArrow(place, f"key binary, vec {kind}, ids array<long>, row int, col int")
        counted = placed.groupBy("row", "col").count().collect()  # MOST_CENTROIDS squared at most
        size = (len(books.value.left), len(books.value.right))
        held = np.zeros(size, np.int64)
        for r in counted:
            held[r.row, r["col"]] = r["count"]
        wanted = math.ceil(books.value.share * n) + 1
        occupied = spark.sparkContext.broadcast(held)
        # A walk is long for a row of its size, so rows are dealt by their number.
        n_asked = named.count()
        texts = named.groupBy("key").agg(F.first("vec").alias("vec")).repartition(max(1, math.ceil(n_asked / WALKS)), "key")

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and row of cells that it visits, with the columns."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                left, right = books.value.distances(_vectors(batch.column("vec"), width))
                of, row, cols = [], [], []
                for i in range(batch.num_rows):
                    r, c = nearest_cells(left[i], right[i], occupied.value, wanted)
                    order = np.argsort(r, kind="stable")
                    begin = np.flatnonzero(np.append(True, np.diff(r[order]) != 0))
                    of.append(np.full(len(begin), i))
                    row.append(r[order][begin])
                    cols += np.split(c[order], begin[1:])
                own = batch.take(pa.array(np.concatenate(of)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(c) for c in cols])), pa.int32()), pa.array(np.concatenate(cols), pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(row), pa.int32()), lists], names=["key", "vec", "row", "cols"])

        # Rows of cells that hold many entries, and many queries, are cut into blocks: every block of entries meets every block of queries.
        blocks = F.array(*[F.lit(int(math.ceil(x / ENTRY_BLOCK)) or 1) for x in held.sum(axis=1)])
        query_blocks = max(1, math.ceil(n_asked / QUERY_BLOCK))
        part = lambda n_blocks: F.pmod(F.xxhash64("key"), n_blocks).cast("int")
        every = lambda n_blocks: F.explode(F.sequence(F.lit(0), n_blocks - 1))
        e = placed.withColumn("slice", part(F.get(blocks, F.col("row")))).withColumn("turn", every(F.lit(query_blocks)))
        q = texts.mapInArrow(walk, f"key binary, vec {kind}, row int, cols array<int>").withColumn("turn", part(F.lit(query_blocks))).withColumn("slice", every(F.get(blocks, F.col("row"))))
        best = (
            e.select("row", "slice", "turn", "vec", "ids", "col").groupBy("row", "slice", "turn")
            .cogroup(q.select("row", "slice", "turn", "key", "vec", "cols").groupBy("row", "slice", "turn"))
            .applyInArrow(lambda a, b: _best_of_block(a, b, width, k + 1), "key binary, id long, score double")
        )
        ranked = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        top = best.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k + 1)
        lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
        others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
        found = tables.write(named.select(F.col("id").alias("query_id"), "key").join(lists, "key").select("query_id", F.posexplode(others).alias("rank", "f")), "found")
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
