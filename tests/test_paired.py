import itertools
import math
import random

import pytest

from meridian.operators import paired as P


def ranks(values):
    """Mean places of |d|, by counting."""
    return [sum(abs(o) < abs(v) for o in values) + (sum(abs(o) == abs(v) for o in values) + 1) / 2 for v in values]


def by_all_signs(values):
    """Share of all ways to sign the ranks whose lesser sum is no greater."""
    r = ranks(values)
    total = sum(r)
    seen = min(s := sum(x for x, v in zip(r, values, strict=True) if v > 0), total - s)
    sums = [sum(itertools.compress(r, way)) for way in itertools.product((0, 1), repeat=len(r))]
    return sum(min(s, total - s) <= seen for s in sums) / len(sums)


def test_chances_match_enumeration():
    for n in range(1, 40):
        for k in range(n + 1):
            away = sum(math.comb(n, i) for i in range(n + 1) if abs(2 * i - n) >= abs(2 * k - n)) / 2**n
            assert P.sign_p(k, n) == pytest.approx(away)
    assert P.sign_p(499_000, 1_000_000) == pytest.approx(math.erfc(999.5 / 500 / math.sqrt(2)), rel=1e-3)  # half a step nearer to the middle
    assert P.sign_p(0, 10**9) == 0.0 and P.sign_p(5 * 10**8, 10**9) == 1.0
    rnd = random.Random(8)
    for n in (1, 3, 6, 9, 12):
        values = [rnd.gauss(0.4, 1) for _ in range(n)]
        plus = sum(r for r, v in zip(ranks(values), values, strict=True) if v > 0)
        assert P.signed_rank_p(min(plus, n * (n + 1) / 2 - plus), n, 0) == pytest.approx(by_all_signs(values))
    exact, normal = P.signed_rank_p(400, 50, 0), P.signed_rank_p(400, 51, 0)
    assert 0.01 < normal < exact < 0.05


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_groups_match_counting(spark, blocks):
    rnd, rows = random.Random(2), [("zero", 0.0), ("zero", 0.0), ("one", 2.5), (None, 1.0), (None, -2.0), ("null", None)]
    rows += [("tied", float(rnd.randint(-4, 5))) for _ in range(300)] + [("free", rnd.gauss(0.1, 1)) for _ in range(40)] + [("hot", rnd.choice([1.0, -1.0, 0.0, 7.0])) for _ in range(2000)]
    given = spark.createDataFrame(rows, "network string, d double")
    found = {r.network: r for r in P.paired_tests(given, "network", "d", blocks=blocks).collect()}
    assert set(found) == {"zero", "one", None, "tied", "free", "hot"}
    for name, r in found.items():
        all_ = [d for g, d in rows if g == name and d is not None]
        some = [d for d in all_ if d]
        assert (r.n, r.n_pos, r.n_neg, r.n_zero) == (len(all_), sum(d > 0 for d in some), sum(d < 0 for d in some), len(all_) - len(some))
        assert r["mean"] == pytest.approx(sum(all_) / len(all_))
        if not some:
            assert (r.w_plus, r.w_minus, r.z, r.sign_p, r.signed_rank_p) == (None,) * 5
            continue
        placed = list(zip(ranks(some), some, strict=True))
        assert r.w_plus == pytest.approx(sum(k for k, v in placed if v > 0)) and r.w_minus == pytest.approx(sum(k for k, v in placed if v < 0))
        m, sizes = len(some), [abs(v) for v in some]
        ties = sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
        assert r.z == pytest.approx((r.w_plus - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48))
        assert r.sign_p == pytest.approx(P.sign_p(r.n_pos, m))
        assert (r.signed_rank_p is None) == (m < 6) and (m < 6 or 0 < r.signed_rank_p <= 1)
    assert found["tied"].signed_rank_p == pytest.approx(math.erfc(abs(found["tied"].z) / math.sqrt(2)))
    assert P.paired_tests(given.filter("false"), "network", "d").count() == 0
