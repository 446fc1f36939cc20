import random
import zlib

import numpy as np
import pytest

from meridian.llm import kneser_ney_langid as L
from meridian.llm.kneser_ney_langid import BITS, CLASSES, DISCOUNT, ORDER, Scorer, class_table, fit, gram_codes, identify, predict, train


def slow_log_prob(counts, gram, lang):
    """Interpolated Kneser-Ney by its definition; counts: {(gram tuple, lang): n}."""
    table = {g: n for (g, x), n in counts.items() if x == lang}
    level = {ORDER: table}
    for n in range(ORDER - 1, 0, -1):
        level[n] = {}
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1

    def p(g):
        n = len(g)
        of = level[n]
        ctx = [v for k, v in of.items() if k[:-1] == g[:-1]]
        if n == 1:
            total = sum(of.values())
            return max(of.get(g, 0) - DISCOUNT, 0) / total + DISCOUNT * len(of) / total / (5 + 2)
        if not ctx:
            return p(g[1:])
        return max(of.get(g, 0) - DISCOUNT, 0) / sum(ctx) + DISCOUNT * len(ctx) / sum(ctx) * p(g[1:])

    return np.log(p(gram))


def test_probabilities_match_definition():
    letters = list("abcde")
    classes = class_table(letters)
    counts = {}
    for lang, text in (("x", "abba cabbage bad"), ("y", "dead bee deed")):
        for c in gram_codes([text], classes)[0].tolist():
            g = tuple((c >> (BITS * k)) & (CLASSES - 1) for k in range(ORDER - 1, -1, -1))
            counts[g, lang] = counts.get((g, lang), 0) + 1
    code = np.array([sum(x << (BITS * (ORDER - 1 - i)) for i, x in enumerate(g)) for g, _ in counts])
    model = fit(np.array(["xy".index(x) for _, x in counts]), code, np.array(list(counts.values())), ["x", "y"], letters)
    probe = np.array([*code.tolist(), 0o1234, 5, 1 << 20])
    got = model.log_probs(probe)
    for c, row in zip(probe.tolist(), got, strict=True):
        g = tuple((c >> (BITS * k)) & (CLASSES - 1) for k in range(ORDER - 1, -1, -1))
        assert row == pytest.approx([slow_log_prob(counts, g, x) for x in "xy"], rel=1e-5)
    entropy, letters_of = Scorer(model)(["bad", "", "?!", "abba"])
    assert letters_of.tolist() == [3, 0, 0, 4] and entropy[3, 0] < entropy[3, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == docs.count() and (held.held_out == held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert identify(docs).orderBy("doc_id").collect() == identify(other).orderBy("doc_id").collect()


def test_awkward_rows(awkward, none):
    found = identify(awkward).collect()
    assert len(found) == awkward.count()
    assert {r.lang_pred for r in found if r.doc_id in (300, 301, 302, 310)} == {"und"}
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert identify(none).count() == 0
    unlabelled = awkward.withColumn("lang", awkward["lang"].substr(0, 0).cast("string")).filter("false").unionByName(awkward)
    assert predict(unlabelled, train(none)).filter("lang_pred != 'und'").count() == 0


def test_rare_ngrams_of_a_small_language_count(spark, monkeypatch):
    """A hot language with over two million n-grams leaves those that a small one has once each."""
    rnd = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüßàáâãåæçèéêëìíîïðñòóôõøùúûýþÿāăąćĉċčďđ"[:62]
    hot = [(i, "".join(rnd.choices(alphabet, k=100_000)), "hot") for i in range(36)]
    small = [(100, "zebra quilt vixen jumbo", "small")]
    docs = spark.createDataFrame(hot + small, "doc_id long, text string, lang string").repartition(8)
    model = train(docs)
    assert len(model.grams[-1].lang) > 2_000_000
    classes = class_table(model.letters)
    monkeypatch.setattr(L, "CALIBRATION_DOCS", 0)
    model = train(docs)
    counts = [np.unique(np.concatenate([gram_codes([t], classes)[0] for _, t, x in hot + small if x == lang]), return_counts=True) for lang in model.langs]
    lang = np.repeat(np.arange(2), [len(c) for c, _ in counts])
    slow = fit(lang, np.concatenate([c for c, _ in counts]).astype(np.int64), np.concatenate([n for _, n in counts]), model.langs, model.letters)
    probe = np.concatenate([counts[0][0][:1000], counts[1][0]])
    assert np.allclose(model.log_probs(probe), slow.log_probs(probe), rtol=1e-6)
    entropy = Scorer(model)([small[0][1]])[0][0]
    assert entropy[model.langs.index("small")] < entropy[model.langs.index("hot")]


def test_languages_of_other_scripts_beside_a_hot_one(spark):
    """Every letter that is learned has a class of its own, so small scripts are told apart."""
    rnd = random.Random(3)
    scripts = {"hot": "abcdefghijklmnopqrstuvwxyzéàèêôûîäöüßåæøñçãõ", "uk": "абвгґдеєжзиіїйклмноп", "bg": "абвгдежзийклмнопърстуф", "zh": [chr(0x4E00 + i) for i in range(3000)], "ja": [chr(0x3041 + i) for i in range(80)]}
    word = lambda x: "".join(rnd.choices(scripts[x], k=rnd.randint(2, 6)))
    rows = [(i, " ".join(word(x) for _ in range(60)), x) for i, x in enumerate(["hot"] * 200 + ["uk", "bg", "zh", "ja"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len({r.lang for r in found}) == 5 and all(r.lang == r.lang_pred for r in found)
