import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from meridian.llm import pseudo_likelihood
from meridian.llm.pseudo_likelihood import CONTEXT, ENDINGS, IDS, Model, forward, gradient, score, start, train, train_and_score


def plain_words(text):
    """Words of a text as the operator folds them: A-Z lowered, stops at the ends gone."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(w.strip(".,;:!?") or w).encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)]


def slow_scores(model, counts, text, own):
    """Words of a text, and its score, word by word; ``own`` words have an id of their own."""
    stems, ending = plain_words(text), lambda w: zlib.crc32(w[-3:]) % ENDINGS
    ids = [own.get(w) or IDS - ENDINGS + ending(w) for w in stems]
    in_bucket = {}
    for w, n in counts.items():
        if w not in own:
            in_bucket.setdefault(ending(w), []).append(n)
    p, total = {k: v.astype(float) for k, v in model.params.items()}, 0.0
    for i, t in enumerate(ids):
        x = np.concatenate([p["embed"][ids[i + k] if 0 <= i + k < len(ids) else 0] for k in CONTEXT])
        h = np.tanh(x @ p["mix"] + p["mix0"])
        z = h @ p["group"] + p["group0"]
        y = (h * p["gate"][t >> 6]) @ p["place"] + p["place0"][t >> 6]
        total += z[t >> 6] - math.log(np.exp(z).sum()) + y[t & 63] - math.log(np.exp(y).sum())
        if stems[i] not in own:
            others = in_bucket.get(ending(stems[i]), [])
            share = counts[stems[i]] - 0.75 if stems[i] in counts else 0.75 * len(others)
            total += math.log(share / sum(others)) if others else 0.0
    return len(ids), total


@pytest.mark.parametrize("own_words, known", [(4031, 100_000), (40, 100_000), (40, 90), (40, 0)])
def test_scores_match_brute_force(awkward, own_words, known):
    """With every word known, with rare words that travel with the model, with rare words in the table, and with all there."""
    taught = awkward.filter("doc_id not in (3, 304, 305) or doc_id is null")  # the others bring unseen words
    model = train(taught, rounds=1, known=known, most_own=own_words)
    counts = Counter(w for r in taught.collect() for w in plain_words(r.text))
    own = {w: i for w, i in model.words.ranks.items() if i <= own_words}
    ordered = sorted(counts, key=lambda w: (-counts[w], w))
    assert list(own) == ordered[: len(own)] and len(model.words.ranks) <= known
    assert len(model.words.ranks) + model.gains.count() == len(counts)
    words, coded = model.words, awkward.filter("doc_id < 303 or doc_id > 304")
    local = {(r.doc_id, r.n_tokens): r for r in score(coded, Model(words, model.gains, model.params)).collect()}
    assert score(awkward, model).count() == awkward.count()
    for r in coded.collect():
        n, total = slow_scores(model, counts, r.text, own)
        assert local[r.doc_id, n].log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3)
        assert local[r.doc_id, n].mean_log_likelihood == (pytest.approx(total / n, rel=1e-3) if n else None)


def test_shares_of_a_bucket_add_up_to_one(awkward):
    words, gains, _ = pseudo_likelihood.vocabulary(awkward, known=200, most_own=10)
    sums = np.exp(words.unseen)
    for w, i in words.ranks.items():
        if i > 10:
            sums[zlib.crc32(w[-3:]) % ENDINGS] += np.exp(words.shares[i])
    far = {r.hash: r.gain for r in gains.collect()}
    texts = pa.array([r.text for r in awkward.collect()])
    stems = {w for t in texts.to_pylist() for w in plain_words(t)} - set(words.ranks)
    assert len(stems) == len(far) > 0
    for w in stems:
        sums[zlib.crc32(w[-3:]) % ENDINGS] += np.exp(words.unseen[zlib.crc32(w[-3:]) % ENDINGS] + far[np.uint64(xxhash.xxh64_intdigest(w, seed=42)).astype(np.int64)])
    assert sums == pytest.approx(np.ones(ENDINGS))


def test_two_rounds_mask_every_word_once():
    sizes = np.array([3, 0, 8, 1, 5])
    both = [pseudo_likelihood.masked_in(turn, sizes).tolist() for turn in (0, 1)]
    assert sorted(both[0] + both[1]) == list(range(17)) and all(both)


def test_a_word_that_the_corpus_has_more_often_scores_higher(spark):
    docs = spark.createDataFrame([(i, f"the zaq{'' if i % 2 else 'x'}ing of it") for i in range(3)] + [(9, "the")], "doc_id long, text string")
    found = {r.doc_id: r.log_likelihood for r in train_and_score(docs).collect()}
    assert found[0] == pytest.approx(found[2]) and found[0] > found[1]


def test_gradient_matches_differences():
    rnd = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in start(rnd.integers(1, 50, IDS).astype(float), 1).items()}
    around, target = rnd.integers(0, IDS, (40, 4)), rnd.integers(0, IDS, 40)
    for k, g in gradient(p, around, target).items():
        at = np.unravel_index(abs(g).argmax(), g.shape)
        p[k][at] += 1e-5
        up = -forward(p, around, target)[0].mean()
        p[k][at] -= 2e-5
        down = -forward(p, around, target)[0].mean()
        p[k][at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-6)


def test_order_is_learned(spark):
    rnd = random.Random(6)
    follows = {w: rnd.sample("abcdefghijkl", 2) for w in "abcdefghijkl"}

    def chain(n):
        w, out = "a", []
        for _ in range(n):
            w = rnd.choice(follows[w])
            out.append(w)
        return out

    docs = spark.createDataFrame([(i, " ".join(chain(400))) for i in range(150)], "doc_id long, text string")
    words = [chain(200) for _ in range(10)]
    held = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join(rnd.sample(w, len(w)))) for i, w in enumerate(words)]
    found = {r.doc_id: r.mean_log_likelihood for r in score(spark.createDataFrame(held, "doc_id long, text string"), train(docs, rounds=3)).collect()}
    assert all(found[i] > found[100 + i] + 0.2 for i in range(10))


def test_empty_table(none):
    assert score(none, train(none)).count() == 0 and train_and_score(none).count() == 0


def test_gradient_in_blocks_is_that_of_all_at_once():
    """Over several blocks and groups the same as by summing what each target adds to each cell."""
    rng, L = np.random.default_rng(5), pseudo_likelihood
    n = 2 * L.CHUNK + 77
    p = L.start(1e5 / np.arange(1, L.IDS + 1), 3)
    p |= {"gate": rng.normal(size=L.SHAPES["gate"]).astype(np.float32)}
    target, context = rng.integers(0, L.IDS, n), rng.integers(0, L.IDS, (n, 2 * L.SIDE))
    logs, (x, h, gated, ez, sz, ey, sy, group, place, row) = L.forward(p, context, target)
    dz, dy = ez / sz[:, None], ey / sy[:, None]
    assert np.allclose(logs, np.log(dz[row, group]) + np.log(dy[row, place]), atol=1e-4)
    dz[row, group] -= 1
    dy[row, place] -= 1
    dgated = dy @ p["place"].T
    dh = (dz @ p["group"].T + dgated * p["gate"][group]) * (1 - h * h)
    embed, gate, place0 = (np.zeros(L.SHAPES[k]) for k in ("embed", "gate", "place0"))
    np.add.at(embed, context.ravel(), (dh @ p["mix"].T).reshape(-1, L.DIM))
    np.add.at(gate, group, dgated * h)
    np.add.at(place0, group, dy)
    whole = {"embed": embed, "gate": gate, "place0": place0, "mix": x.T @ dh, "mix0": dh.sum(axis=0), "group": h.T @ dz, "group0": dz.sum(axis=0), "place": gated.T @ dy}
    found = L.gradient(p, context, target)
    assert found.keys() == whole.keys()
    for k, g in whole.items():
        assert np.allclose(found[k], g / n, rtol=1e-3, atol=1e-6), k


def test_work_on_a_word_lies_in_cache():
    assert 2 * 4 * pseudo_likelihood.CHUNK * (pseudo_likelihood.GROUPS + pseudo_likelihood.PLACES) <= 1 << 21
