"""The whole pipeline over the smallest tables, stage by stage against plain forms of each."""

import collections
import re

import corpus_pipeline as P
from meridian.llm import line_suffix_dedup
from meridian.llm.best_fit_pack import pack
from meridian.llm.quality_outliers import judge
from meridian.llm.shared import materialize, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def test_stages_and_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {"documents": docs}
    before = docs
    for name, stage in P.STAGES[:-1]:
        before = kept[name] = materialize(stage(spark, before, sf_dir), name)
        assert before.columns == docs.columns
    ids = {n: collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in kept.items()}
    assert ids["quality_rules"] == collections.Counter(r.doc_id for r in judge(docs).filter("kept").collect())
    # No run of lines of 160 characters is left twice by the line stage's own account.
    assert line_suffix_dedup.repeated_runs(kept["line_dedup"]).count() == 0
    # One document of each component of the links stays: the least.
    rows = {r.doc_id: shingles(r.text) for r in kept["line_dedup"].collect()}
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    order = sorted(rows)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(rows[a] & rows[b])
            if rows[a] and rows[b] and 100 * both >= 80 * (len(rows[a]) + len(rows[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    assert set(ids["ngram_jaccard_join"]) == {a for a in order if find(a) == a}
    assert set(ids["source_mixing"]) <= set(ids["ngram_jaccard_join"])
    found = P.run(spark, sf_dir).toPandas()
    assert len(found) == pack(kept["source_mixing"], P.tokenizer_file()).count()
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.length.sum() <= 2048 and (part.offset.to_numpy() == part.length.cumsum().to_numpy() - part.length.to_numpy()).all()
    assert set(found.doc_id) == set(ids["source_mixing"])
