import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from meridian.llm import digest as D


def canon(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def test_query_columns_match_brute_force(unique, monkeypatch):
    monkeypatch.setattr(D, "DOCS_A_PART", 7)  # several parts
    rows = {r.doc_id: r.text or "" for r in unique.collect()}
    ids = sorted(rows)
    found = {r.doc_id: r for r in D.edited_fingerprints(unique).collect()}
    assert sorted(found) == ids
    for i, doc_id in enumerate(ids):
        text, following = rows[doc_id], rows[ids[(i + 1) % len(ids)]]
        k = len(text) // 4
        new = text[: len(text) - k] + following[:k]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == float(canon(new) == canon(text)) and r.near_next == float(canon(following) == canon(text))
        assert (r.fingerprint == r.edited_fingerprint) == (canon(new) == canon(text))
        assert r.copy_of == min(d for d in ids if canon(rows[d]) == canon(text))
        for other in ids:
            assert (found[other].fingerprint == r.fingerprint) == (canon(rows[other]) == canon(text))


def test_collisions_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "A", "b", "c", "b "])], "doc_id long, text string")
    docs = D.with_row_key(docs)
    keyed = docs.select("doc_id", "row_key", F.lit("same").alias("fingerprint"))
    found = {r.doc_id: r.fingerprint for r in D.resolve_collisions(keyed, docs).collect()}
    assert found[0] == found[1] and found[2] == found[4] and len(set(found.values())) == 3
    monkeypatch.setattr(D, "BROADCAST_MEMBERS", 0)
    assert {r.doc_id: r.fingerprint for r in D.resolve_collisions(keyed, docs).collect()} == found


def in_order(rows):
    """Texts by doc_id, then text; those without an id last."""
    return sorted(((doc_id is None, doc_id or 0, text or "") for doc_id, text in rows))


@pytest.mark.parametrize("size", [7, 1500])
def test_every_row_has_a_row(awkward, spark, monkeypatch, size):
    """Rows without a doc_id, with a shared one, and repeated rows."""
    monkeypatch.setattr(D, "DOCS_A_PART", size)
    more = spark.createDataFrame([(7, "x y"), (7, "X  y"), (None, "x y"), (None, "x y"), (10**12, "z")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(more)
    rows = in_order(docs.collect())
    expected = []
    for i, (missing, doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        copies = [r[1] for r in rows if canon(r[2]) == canon(text) and not r[0]]
        likeness = (float(canon(new) == canon(text)), float(canon(following) == canon(text)))
        expected.append((None if missing else doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *likeness, min(copies, default=None)))
    found = D.edited_fingerprints(docs).collect()
    told = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.copy_of) for r in found]
    assert sorted(map(repr, told)) == sorted(map(repr, expected))
    plain = D.fingerprint(docs).collect()
    assert sorted(repr((r.doc_id, r.copy_of)) for r in plain) == sorted(repr((e[0], e[5])) for e in expected)
    assert sorted(r.fingerprint for r in plain) == sorted(r.fingerprint for r in found)


def test_only_rows_without_ids_and_empty_tables(none, spark):
    assert D.edited_fingerprints(none).count() == 0 == D.fingerprint(none).count()
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert D.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    two = spark.createDataFrame([(None, "abcdefgh"), (None, "ABCDEFGH")], "doc_id long, text string")
    assert {(r.doc_id, r.near_next, r.copy_of) for r in D.edited_fingerprints(two).collect()} == {(None, 1.0, None)}
