import itertools
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meridian.llm import queries
from meridian.llm.filter_audit import Lattice, audit, failure_counts, text_failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def expected(docs, labels):
    """Every order played through, document by document."""
    least, told = {}, defaultdict(set)
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", math.inf), r.doc_id)
    for r in labels:
        told[r.doc_id] |= {name for name in ("good", "toxic") if r["quality" if name == "good" else "toxic"] == 1}
    parts = defaultdict(list)
    for r in docs:
        text = r.text or ""
        own = fails(text) | {"E": (math.inf if r.doc_id is None else r.doc_id) > least.get(text, math.inf)}
        parts[r.source or ""].append(({k for k, v in own.items() if v}, told[r.doc_id] if r.doc_id is not None else set()))
    out, removed_by = [], defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                before = set(order[: step - 1])
                removed_by[part, f] += len(gone)
                out.append((part, "".join(order), step, f, len(left), len(gone), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows),
                    sum("good" in r[1] for r in gone), sum("toxic" in r[1] for r in gone)))
    return sorted((*row, removed_by[row[0], row[3]]) for row in out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 24)] + [(100, None, 1), (100, 1, None), (200, None, None), (None, 1, 1), (3, 1, 1), (999, 1, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_matches_every_order(spark, awkward, labels):
    capitals = spark.createDataFrame([(400, "AB cd # " * 120, "en", "a", 0), (401, "Ab cd " * 150, "en", "b", 0), (402, "AB cd # " * 120, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = awkward.unionByName(capitals, allowMissingColumns=True)
    found = audit(failure_counts(docs, labels, [*text_failures(F.col("text")).values()]), "ABCDE")
    assert rows_of(found) == expected(docs.collect(), labels.collect())


def test_empty(none, labels):
    assert audit(failure_counts(none, labels, [*text_failures(F.col("text")).values()]), "ABCDE").collect() == []


def test_lattice():
    for n in range(1, 6):
        lattice = Lattice(n)
        passed = defaultdict(int)
        for order in itertools.permutations(range(n)):
            for place in lattice.path(order):
                passed[place] += 1
        assert lattice.reaching[-1] == lattice.leaving[0] == math.factorial(n)
        assert [lattice.weight(e) for e in lattice.edges] == [passed[i] for i in range(len(lattice.edges))]


def test_fewer_filters(spark):
    """Any number of filters can be asked for; shares of all filters add up to what is removed, in every order."""
    counts = spark.createDataFrame([("p", m, m % 2 == 0, False, m + 1) for m in range(8)], "part string, fails int, good boolean, toxic boolean, n long")
    found = audit(counts, "XYZ").collect()
    assert len(found) == 6 * 3
    shapley = {r.filter: r.shapley for r in found}
    assert sum(shapley.values()) == 6 * sum(m + 1 for m in range(1, 8))


def test_registered_query(spark, sf_dir):
    docs, told = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels"))
    assert rows_of(queries.op12_filter_audit(spark, sf_dir)) == expected(docs, told)
