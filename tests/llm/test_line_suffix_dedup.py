import random

import pytest

from meridian.llm.line_suffix_dedup import dedup_lines, drop_emptied


def brute(docs, least):
    """By definition: any two places are compared as far as they agree, and where that has the least size, the later one goes."""
    order = [(d, (docs[d] or "").split("\n")) for d in sorted(docs)]
    where, gone = {}, {d: set() for d in docs}
    for d, (_, lines) in enumerate(order):
        for at, line in enumerate(lines):
            for e, first in where.get(line, []):
                other = order[e][1]
                if at and first and lines[at - 1] == other[first - 1]:
                    continue  # the run begins earlier
                n = next((n for n, (x, y) in enumerate(zip(lines[at:], other[first:])) if x != y), min(len(lines) - at, len(other) - first))  # noqa: B905
                if sum(len(x) + 1 for x in lines[at : at + n]) >= least:
                    gone[order[d][0]] |= set(range(at, at + n))
            where.setdefault(line, []).append((d, at))
    return {d: ("\n".join(x for i, x in enumerate(lines) if i not in gone[d]), len(gone[d])) for d, lines in order}


def test_runs_are_deleted_to_their_last_line(spark):
    """Short lines go with the run they end, or begin, and stay elsewhere."""
    long, docs = "A" * 170, {}
    docs[1], docs[2], docs[3] = f"{long}\nshort line\nend one", f"start\n{long}\nshort line\nend two", "x\nshort line\nshort line\ny"
    docs[4], docs[5] = f"a\nb\n{long}\nc\nd\ne", f"b\n{long}\nc\nd\nother"
    found = {r.doc_id: (r.text, r.lines_deleted) for r in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert found == brute(docs, 160)
    assert found[2] == ("start\nend two", 2) and found[3][1] == 0 and found[5] == ("other", 4)


@pytest.mark.parametrize("least", [5, 12, 40])
def test_random_sequences_match_brute_force(spark, least):
    rnd = random.Random(least)
    docs = {i: "\n".join(rnd.choice(["a", "bb", "", "ccc", "dd dd"]) for _ in range(rnd.randint(0, 40))) for i in range(50)}
    docs[50] = "\n".join(["x"] * 300)
    docs[51] = docs[50] + "\ny"
    found = dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), least).collect()
    assert {r.doc_id: (r.text, r.lines_deleted) for r in found} == brute(docs, least)


def test_awkward_rows(awkward, unique):
    found = dedup_lines(unique)
    assert found.columns == [*unique.columns, "line_count", "lines_deleted"]
    rows = {r.doc_id: r for r in found.collect()}
    texts = {r.doc_id: r.text for r in unique.collect()}
    expected = brute(texts, 160)
    for doc_id, (left, gone) in expected.items():
        assert rows[doc_id].lines_deleted == gone
        assert rows[doc_id].text == (None if texts[doc_id] is None else left)
    assert rows[304].lines_deleted >= 3000  # the long text again
    assert dedup_lines(awkward).count() == awkward.count()  # repeated rows and rows without an id stay


def test_emptied_documents_go(unique):
    left = drop_emptied(dedup_lines(unique))
    assert left.columns == unique.columns
    ids = {r.doc_id: r for r in left.collect()}
    assert 201 not in ids and 0 in ids and 300 in ids and 301 in ids
    assert all(r.n_chars == len(r.text) for r in ids.values() if r.text is not None)


def test_empty_table(none):
    assert dedup_lines(none).count() == 0
