import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import multi_index as M
from meridian.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vec string, id int"


def brute(rows, k, asked):
    """By definition: rows (id, vector) that take part, double precision, ties to the smaller id."""
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in sound:
        if asked(i):
            scored = sorted((-(q @ x) / (np.sqrt(q @ q) * np.sqrt(x @ x)), j) for j, x in sound if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1) for i, v in rows], SCHEMA)


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def clustered(n, width, seed=5):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, width))
    return [(i, (centres[i % 12] + 0.5 * rnd.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def test_awkward_rows(spark):
    """Copies in plenty, scaled copies, ties, and rows that take no part; with all seen, the result is exact."""
    rows = clustered(60, 8)
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200 + i, [2 * x for x in rows[1][1]]) for i in range(3)]
    rows += [(300, None), (305, [0.0] * 8), (310, [float("nan")] * 8), (315, [1.0, None] * 4), (320, [float("inf")] * 8), (None, rows[2][1]), (325, [1.0] * 8), (330, [-0.0] + [1.0] * 7)]
    rows += [(335, [0.0] + [1.0] * 7), (340, [1e30] * 8), (345, [1e-30] * 8)]
    rnd = random.Random(2)
    rnd.shuffle(rows)
    more = frame(spark, [*rows, (350, [1.0, 2.0])])  # another length
    found = result(M.search(more, "vec_id", "embedding", F.col("vec_id") % 5 == 0, k=5, recall=1.0))
    wanted = brute([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, lambda i: i % 5 == 0)
    assert set(found) == set(wanted)
    for q, best in wanted.items():
        assert [r for r, _, _ in found[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in found[q]], [s for _, s in best], atol=1e-12)
        clear = {j for j, s in best if s > best[-1][1] + 1e-12}
        assert clear <= {j for _, j, _ in found[q]}
    assert [j for _, j, _ in found[100]] == [0, 101, 102, 103, 104] and [j for _, j, _ in found[0]] == [100, 101, 102, 103, 104]


def test_small_tables(spark):
    few = [(0, [1.0, 0.0]), (5, [0.6, 0.8]), (7, [0.0, 1.0])]
    found = result(M.search(frame(spark, few), "vec_id", "embedding", F.col("vec_id") % 5 == 0))
    assert {q: [(r, j) for r, j, _ in v] for q, v in found.items()} == {0: [(1, 5), (2, 7)], 5: [(1, 7), (2, 0)]}
    assert result(M.search(frame(spark, [(5, [3.0])]), "vec_id", "embedding", F.lit(True))) == {}
    assert result(M.search(frame(spark, [(5, [3.0]), (6, [-2.0])]), "vec_id", "embedding", F.lit(True)))[5] == [(1, 6, -1.0)]
    assert M.search(frame(spark, few).filter("false"), "vec_id", "embedding", F.lit(True)).collect() == []
    assert M.search(frame(spark, few), "vec_id", "embedding", F.lit(False)).collect() == []


@pytest.mark.parametrize("blocks", [(32_768, 8192), (40, 16)])
def test_recall(spark, monkeypatch, blocks):
    """Recall against all pairs; blocks of entries and queries change nothing."""
    monkeypatch.setattr(M, "ENTRY_BLOCK", blocks[0])
    monkeypatch.setattr(M, "QUERY_BLOCK", blocks[1])
    rows = clustered(3000, 16)
    found = result(M.search(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    wanted = brute(rows, 5, lambda i: i % 20 == 0)
    hits = sum(len({j for _, j, _ in found[q]} & {j for j, _ in best}) for q, best in wanted.items())
    assert set(found) == set(wanted) and hits >= 0.9 * 5 * len(wanted)
    score = {(q, j): s for q, best in wanted.items() for j, s in best}
    assert all(abs(s - score[q, j]) < 1e-12 for q, v in found.items() for _, j, s in v if (q, j) in score)


def test_walk_takes_the_nearest_cells():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        left, right, sizes = rnd.normal(size=7), rnd.normal(size=5), rnd.integers(0, 4, (7, 5))
        wanted = int(rnd.integers(1, sizes.sum() + 3))
        rows, columns = M.nearest_cells(left, right, sizes, wanted)
        sums = (left[:, None] + right).ravel()
        order = [c for c in np.argsort(sums) if sizes.ravel()[c]]
        enough = next((i + 1 for i in range(len(order)) if sizes.ravel()[order[: i + 1]].sum() >= wanted), len(order))
        assert [r * 5 + c for r, c in zip(rows, columns, strict=True)] == order[:enough]


def test_registered_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = result(queries.op11_nearest_neighbours(spark, sf_dir))
    wanted = brute(rows, 5, lambda i: i % 50 == 0)
    hits = sum(len({j for _, j, _ in found[q]} & {j for j, _ in best}) for q, best in wanted.items())
    assert set(found) == set(wanted) and hits >= 0.9 * sum(len(b) for b in wanted.values())
