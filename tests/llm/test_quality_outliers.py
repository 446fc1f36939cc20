import collections
import random
import re

import numpy as np
import pytest

from meridian.llm.quality_outliers import FEATURES, judge, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_base_rules_match_brute_force(awkward):
    found = judge(awkward).toPandas()
    texts = awkward.select("doc_id", "text").toPandas()
    assert len(found) == len(texts)
    expected = collections.Counter(stats(t) for t in texts.text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collections.Counter(map(tuple, found[names].itertuples(index=False))) == expected
    failed = (found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words)
    assert (found.base_failed == failed).all()
    assert not found[found.base_failed].kept.any()


def test_empty_table(none):
    assert judge(none).count() == 0


def brute_mcd(x, floors, share, steps):
    """Same starts and steps in numpy, with the exact share of nearest points."""
    median = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(abs(x - median), axis=0), floors)
    z = (x - median) / spread
    unit = z / np.sqrt((z * z).sum(axis=1) + 1e-9)[:, None]
    p = x.shape[1]
    best = None
    for c in (np.eye(p), np.tanh(z).T @ np.tanh(z) / len(x), p * unit.T @ unit / len(x)):
        m, s = median, c * np.outer(spread, spread) + np.diag(floors**2)
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            near = x[np.argsort(d)[: int(np.ceil(share * len(x)))]]
            m, s = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors**2)
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = det, m, s
    _, m, s = best
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)


def test_distances_are_near_brute_force_and_junk_goes(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(80, 400))]
        if i % 8 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    found = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().sort_values("doc_id")
    assert not found[found.doc_id % 8 == 0].kept.any()
    assert found[found.doc_id % 8 != 0].kept.all()
    n = found.n_words.to_numpy(float)
    x = np.stack([np.log1p(n), np.log((found.word_chars + 1) / n), np.log1p(100 * found.n_symbols / (found.word_chars + 1)), np.log1p(found.n_dup_lines), np.arcsin(np.sqrt(found.n_repeat_words / n))], axis=1)
    expected = brute_mcd(x, np.array(list(FEATURES.values())), 0.75, 5)
    near = found.distance.to_numpy() < 20
    assert found.distance.to_numpy()[near] == pytest.approx(expected[near], rel=0.35, abs=0.6)


def test_keep_good_keeps_all_columns(awkward):
    kept = keep_good(awkward)
    assert kept.columns == awkward.columns
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept) == ids(judge(awkward).filter("kept"))


def test_small_groups_lean_on_their_parents(spark):
    """A group of two lies between its own estimate and that of the language; nothing changes at a size."""
    from meridian.llm.quality_outliers import M, X, estimates

    rnd = random.Random(2)
    rows = [(f, "en", *[rnd.gauss(5.0 * (f == "few"), 1.0) for _ in X]) for f in ["many"] * 400 + ["few"] * 2]
    good = spark.createDataFrame(rows, "fine string, coarse string, " + ", ".join(f"{x} double" for x in X))
    found = {r.group: r for r in estimates(good, 0.75, 5).collect()}
    assert abs(found["many"][M[0]]) < 0.5 and abs(found["few"][M[0]]) < 1.0
