import hashlib
import math
from collections import Counter

import pytest

from meridian.llm.poisson_mix import mix, source_rates


def expected_counts(rows, rates, seed=5):
    out = Counter()
    for r in rows:
        key = "|".join(["" if r.doc_id is None else str(r.doc_id), r.source or "", str(seed)])
        u, rate = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52, rates[r.source]
        k, c = 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out[r.doc_id, r.source, r.text] += k
    return +out


@pytest.mark.parametrize("weights,total", [(None, 1.0), ({"a": 3.0, "b": 1.0}, 4.0), ({"a": 1.0}, 900.0)])
def test_counts_match_inverse_poisson(awkward, weights, total):
    docs = awkward.drop("mix_copy") if weights else awkward
    rates = {r.source: r.rate for r in source_rates(docs, weights, 0.5, total).collect()}
    found = mix(docs, weights=weights, total=total)
    assert set(docs.columns) <= set(found.columns)
    rows = docs.select("doc_id", "source", "text").collect()
    assert Counter((r.doc_id, r.source, r.text) for r in found.collect()) == expected_counts(rows, rates)


def test_rates_meet_the_target(awkward):
    rates = source_rates(awkward, {"a": 3.0, "b": 1.0}, 0.5, 2.0).collect()
    size = {r.source: r.size for r in rates}
    wanted = {r.source: r.rate * r.size for r in rates}
    assert wanted["a"] == pytest.approx(1.5 * sum(size.values())) and wanted["b"] == pytest.approx(0.5 * sum(size.values()))
    assert wanted[None] == 0


def test_empty_table(none):
    assert mix(none).count() == 0
    assert mix(none, weights={}).count() == 0
