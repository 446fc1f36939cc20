import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import queries
from meridian.llm.fill_middle import Marks, fill_in_middle, lead_marks, newline_marks, restore


def expected(doc_id, text, unit, fim=100, spm=50, seed=7):
    """By definition, on code points."""
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(parts), "plain", None, None, text
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    pieces = ["\n", "\n\n", "a", "é", "\U0001f600", "<", "P>", "S", "ab cd", "\x8a", "ª", "\x00", "\r\n", " "]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))) for i in range(400)]
    return spark.createDataFrame(rows + [(900, "x<P>y"), (901, "a\nb<M>"), (902, "<S>")], "doc_id long, text string")


@pytest.mark.parametrize("unit,fim,spm", [("line", 100, 50), ("char", 100, 50), ("char", 60, 0), ("line", 0, 50)])
def test_matches_definition(texts, awkward, unit, fim, spm):
    for docs in (texts, awkward):
        found = fill_in_middle(docs, unit=unit, fim_percent=fim, spm_percent=spm)
        rows = found.withColumn("back", restore(F.col("form"), F.col("output"))).collect()
        given = docs.collect()
        assert len(rows) == len(given)
        wanted = sorted(repr((r.doc_id, *expected(r.doc_id, r.text, unit, fim, spm))) for r in given)
        assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in rows) == wanted
        assert all(r.back == (r.text or "") for r in rows)
        assert all(c in found.columns for c in docs.columns)
    assert fim < 100 or len({r.form for r in rows}) == (3 if spm else 2)


def test_marks():
    """Counts and places of marks against the plain ones, words with runs of equal bytes included."""
    rnd = np.random.default_rng(1)
    for _ in range(50):
        data = rnd.choice(np.array([0x0A, 0x0B, 0x8A, 0x00, 0x80, 0xC3, 0xFF, 0x7F], np.uint8), 8 * rnd.integers(1, 9))
        for marks, plain in ((newline_marks, data == 0x0A), (lead_marks, (data & 0xC0) != 0x80)):
            m = Marks(marks(data.view(np.uint64)))
            assert (m.rank(np.arange(len(data) + 1)) == np.append(0, np.cumsum(plain))).all()
            assert (m.select(np.arange(plain.sum())) == np.flatnonzero(plain)).all()


def test_edges(spark, none):
    assert fill_in_middle(none).collect() == []
    clash = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id long, text string, N int, draws string")
    row = fill_in_middle(clash).collect()[0]
    assert row.n == 2 and row.draws == "x"
    with pytest.raises(ValueError):
        fill_in_middle(clash, unit="word")


def test_registered_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = queries.op13_fill_in_middle(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        n, form, prefix, middle, output = expected(r.doc_id, docs[r.doc_id], "line")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
