import random
import re

import pytest

from meridian.llm import jaccard_join as J


def sets_of(rows, k):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        out[r.doc_id] = frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k,percent,small,broadcast", [(4, 85, 24, 2_000_000), (5, 80, 2, 2_000_000), (2, 60, 2, 0)])
def test_components_match_brute_force(unique, monkeypatch, k, percent, small, broadcast):
    monkeypatch.setattr(J, "SMALL_REGION", small)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "TURNS", 3)
    monkeypatch.setattr(J, "BROADCAST_IDS", broadcast)
    sets = sets_of(unique.collect(), k)
    found = {r.doc_id: r for r in J.jaccard_components(unique, k, percent).collect()}
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in found.items()} == brute(sets, percent)


def test_chains_of_near_copies(spark, monkeypatch):
    """A group whose members link only to their neighbours, in regions that must be split."""
    monkeypatch.setattr(J, "SMALL_REGION", 3)
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(40)] + [(100 + i, " ".join(words[i:])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.jaccard_components(docs, 4, 85).collect()}
    assert found == brute(sets_of(docs.collect(), 4), 85)


def test_awkward_rows_and_empty_table(awkward, none):
    assert J.jaccard_components(awkward).count() == awkward.count()
    assert J.jaccard_components(none).count() == 0
    kept = J.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    # The row without an id comes first and so stands for its copy; rows without words all stay.
    assert {0, 300, 301, 306, None} <= set(ids) and not {201, 307, 3} & set(ids)
    assert ids.count(2) == 1 and ids.count(None) == 2


def cloud(seed, copies, words=90, edits=6):
    """Copies of a text with random words replaced, left out or put in, some of them again from others' words."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randint(0, 400)}" for _ in range(words)]
    texts = [base]
    for i in range(copies):
        own = list(rnd.choice(texts) if rnd.random() < 0.3 else base)
        for _ in range(rnd.randint(0, edits)):
            at = rnd.randrange(len(own))
            kind = rnd.random()
            new = rnd.choice([f"n{i}", f"e{rnd.randint(0, 9)}"])
            own[at : at + (kind < 0.8)] = [] if kind < 0.2 else [new]
        texts.append(own)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed,k,percent,small,turns", [(1, 4, 85, 2, 10), (3, 3, 70, 2, 2), (5, 1, 60, 8, 4)])
def test_clouds_of_near_copies(spark, monkeypatch, seed, k, percent, small, turns):
    """Regions of many documents take pivots, and their cells are joined by what tells them from the pivot."""
    monkeypatch.setattr(J, "SMALL_REGION", small)
    monkeypatch.setattr(J, "TURNS", turns)
    taken = []
    whole = J._turn
    monkeypatch.setattr(J, "_turn", lambda *a: taken.append(1) or whole(*a))
    texts = cloud(seed, 120) + cloud(seed + 50, 40, words=40) + cloud(seed + 90, 20, words=8, edits=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.jaccard_components(docs, k, percent).collect()}
    assert found == brute(sets_of(docs.collect(), k), percent)
    assert taken


def test_registered_query(spark, sf_dir):
    """The query over the whole smallest table, against all pairs."""
    from meridian.llm.queries import queries

    found = {r.doc_id: r for r in queries()["op4_ngram_jaccard_join"](spark, sf_dir).collect()}
    sets = sets_of(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), 4)
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in found.items()} == brute(sets, 85)


@pytest.mark.parametrize("small", [1024, 40])
def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, small):
    """Near copies in large groups, of which many link with few others: texts are measured a few times each, whatever the size of a group."""
    monkeypatch.setattr(J, "SMALL_REGION", small)
    asked = []
    whole = J.Corpus.may_be_near
    monkeypatch.setattr(J.Corpus, "may_be_near", lambda self, pairs, share: asked.append(pairs.count()) or whole(self, pairs, share))
    texts = cloud(11, 300, words=120, edits=4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.jaccard_components(docs, 4, 85).collect()}
    assert found == brute(sets_of(docs.collect(), 4), 85)
    if small == 1024:
        assert sum(asked) <= 8 * len(texts)


def test_blocks_bring_every_two_documents_together(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL_REGION", 6)
    rows = [(1, i, 1, 1, 0, i, 0, 20) for i in range(20)]
    regions = spark.createDataFrame(rows, "region long, doc long, n long, e long, pos int, key long, age int, size long")
    met = {}
    for r in J._blocks(regions).collect():
        met.setdefault(r.region, set()).add(r.doc)
    assert all(any({a, b} <= docs for docs in met.values()) for a in range(20) for b in range(a))
    assert max(map(len, met.values())) < 20
