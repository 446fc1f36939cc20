"""Queries about linear models, and about the bias that knowledge states leave possible."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import adjustment as A
from ..operators import criterion as C
from ..operators import equivalence as Q
from ..operators import knowledge as K
from ..operators import meek as M
from ..operators import models as L
from ..operators import radius as R
from ..operators import shells as H
from ..operators.extensions import extensions
from ..operators.fixpoint import settle
from ..sources.population import dags, models
from .graph_queries import ANC, CAUSAL, NODES, PAIRS, VD, VS, _closed
from .space_queries import DRAWN, ENDS, EXTENDED, JUDGED, KNOWN

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.moments(models(dags(spark, sf_dir)))


def total_effect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total effect of every node on each of its descendants."""
    return L.total_effects(models(dags(spark, sf_dir))).withColumn("effect", F.round("effect", DIGITS))


def model_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.entries(_moments(spark, sf_dir), "sigma", "cov").filter("a <= b")
    return found.withColumn("cov", F.round("cov", DIGITS))


def asymptotic_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For first and last node, and each node between as the adjustment set: coefficient, its bias and the variance of its estimator."""
    graphs = _moments(spark, sf_dir).filter(F.size("labels") >= 3).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})
    each = graphs.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels") - 2))).withColumn("z", B.bit(F.col("k")))
    rounded = [(F.round(c, DIGITS) + 0.0).alias(c) for c in ("theta", "bias", "variance")]
    return L.adjusted(each).select("gid", F.get("labels", F.col("k")).alias("z"), *rounded)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-known states with x, y, z, the law of the DAG's model, and the coefficient that is reported."""
    law = "effects array<double>, sigma array<double>"
    kernel = C.chained(A.optimal_of_ends, L.moment_kernel, L.adjusted_kernel, K.known_half(0.5))
    found = C.over_graphs(models(dags(spark, sf_dir)), kernel, f"{ENDS}, {law}, theta double, bias double, variance double, {KNOWN}")
    return found.drop("weights", "noise", "effects")


def ida_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects that the CPDAG alone leaves open, least and greatest, and from how many parent sets."""
    graphs = _states(spark, sf_dir).withColumns({"pa": F.col("fixed"), "nb": F.col("loose")})
    found = L.worst_case_bias(graphs)
    return found.select("gid", *[(F.round(c, DIGITS) + 0.0).alias(c) for c in ("effect_min", "effect_max")], "n_parent_sets")


def worst_case_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.worst_case_bias(_states(spark, sf_dir))
    return found.select("gid", F.round("worst", DIGITS).alias("worst"), "n_parent_sets")


def bias_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst bias by the number of known edges taken back."""
    return L.bias_profile(_states(spark, sf_dir)).select("gid", "d", F.round("beta_up", DIGITS).alias("beta_up"))


def _radii(states: DataFrame) -> DataFrame:
    return L.epsilon_radii(L.bias_profile(states, above=max(L.EPSILONS)), states)


def r_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radii(settle(_states(spark, sf_dir)))


def _budgets(states: DataFrame) -> DataFrame:
    """gid, k: from none to all of the edges that knowledge directs."""
    count = lambda c: F.aggregate(c, F.lit(0), lambda acc, m: acc + B.count(m))
    return states.select("gid", F.explode(F.sequence(F.lit(0), count("pa") - count("fixed"))).alias("k"))


def certified_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = settle(_states(spark, sf_dir))
    return L.certified_band(_radii(states), _budgets(states))


def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a graph: the validity radius, the reported coefficient, the bias that is there, the most there can be (all in the
    units of the effect), and the radius at 10 % of the coefficient."""
    told = _certified(_states(spark, sf_dir)).withColumn("realised_error", F.abs("bias"))
    return told.select("gid", "r_val", *[F.round(c, DIGITS).alias(c) for c in ("theta", "realised_error", "beta_top")], "r_eps_10")


def _certified(states: DataFrame) -> DataFrame:
    """gid, theta, bias, r_val, beta_top, r_eps_10, beside each state's row; only states with many others above them are searched over tables."""
    kept = "labels array<int>, fixed array<long>, loose array<long>, pa array<long>, nb array<long>, sigma array<double>"
    told = settle(C.over_graphs(states, L.certificate_kernel, f"r_val int, beta_top double, r_eps_10 int, {kept}"))
    columns = ("gid", "theta", "bias", "r_val", "beta_top", "r_eps_10")
    done, left = told.filter("r_val is not null").select(*columns), told.filter("r_val is null")
    if left.isEmpty():
        return done
    mine = F.transform(F.arrays_zip("pa", "fixed"), lambda z: B.minus(z["pa"], z["fixed"]))
    valid = R.up_radius(left.select("gid", "labels", "fixed", "loose", "pa", "nb", "x", "y", "z").withColumns({"claims": mine, "legal": F.lit(True)})).select("gid", F.col("radius").alias("r_val"))
    tenth = _radii(left).filter(F.col("epsilon") == L.CERTIFIED).select("gid", F.col("r_eps").alias("r_eps_10"))
    return done.union(left.drop("r_val", "r_eps_10").join(valid, "gid").join(tenth, "gid").select(*columns))


def mean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias over all ways to drop d of the known edges: its mean with the bounds that the shell's extremes give."""
    found = H.mean_bounds(H.mean_profile(_states(spark, sf_dir)))
    rounded = [F.round(c, DIGITS).alias(c) for c in ("mean", "beta_up", "lower", "upper")]
    return found.select("gid", "d", F.col("n_evaluated").alias("n_subsets"), "n_states", *rounded)


def covered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.covered_edges(dags(spark, sf_dir))


def class_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many DAGs of its class are how many turns of covered edges away from each graph's DAG."""


    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        up, loose = M.completed(C._matrix(part.column("pa")))
        return None, {"own": part.column("pa"), "pa": C.lists_of(up, part.column("pa")), "nb": C.lists_of(loose, part.column("pa"))}

    members = extensions(C.over_graphs(dags(spark, sf_dir), kernel, "own array<long>, pa array<long>, nb array<long>"))
    reached = members.withColumn("distance", Q.turns_apart(F.col("pa"), F.col("own")))
    return reached.groupBy("gid", "distance").agg(F.count("*").alias("n_dags"))


def queries() -> dict[str, Query]:
    found = (total_effect_paths, model_covariance, asymptotic_variance, ida_effects, worst_case_bias, bias_profile, r_epsilon_grid, certified_band, certificate, mean_profile, covered_edges, class_walk)
    return {f.__name__: f for f in found}


MODEL = """
we as (
  select gid, t, h, case when substr(md5(gid || '|' || t || '|' || h || '|w'), 5, 1) < '8' then -1.0 else 1.0 end::double
    * (0.3::double + (('0x' || substr(md5(gid || '|' || t || '|' || h || '|w'), 1, 4))::int::double / 65537.0::double) * 1.2::double) as w from e),
no as (select gid, v, 0.5::double + ('0x' || substr(md5(gid || '|' || v || '|n'), 1, 4))::int::double / 65537.0::double as var from nodes),
pt(gid, a, v, h, p) as (select gid, v, v, 0, 1.0::double from nodes union all select pt.gid, pt.a, we.h, pt.h + 1, pt.p * we.w from pt join we on we.gid = pt.gid and we.t = pt.v),
te as (select gid, a, v as b, sum(p) as effect from pt group by gid, a, v),
cv as (
  select l.gid, l.b as a, r.b as b, sum(l.effect * r.effect * no.var) as cov from te l join te r on r.gid = l.gid and r.a = l.a
  join no on no.gid = l.gid and no.v = l.a group by l.gid, l.b, r.b)
"""

#: Sets of regressors (gid, p: bits by node, from 1): the law left after each is taken out, one node after the other.
SWEPT = """
sw(i, gid, p, a, b, c) as (
  select 0, ps.gid, ps.p, n.v, o.v, coalesce(cv.cov, 0.0) from ps join nodes n on n.gid = ps.gid join nodes o on o.gid = ps.gid
  left join cv on cv.gid = ps.gid and cv.a = n.v and cv.b = o.v
  union all
  select k.i + 1, k.gid, k.p, k.a, k.b, case when (k.p >> (k.i + 1)) & 1 = 1 then k.c - l.c * r.c / m.c else k.c end
  from sw k left join sw l on l.gid = k.gid and l.p = k.p and l.a = k.a and l.b = k.i + 1
    left join sw r on r.gid = k.gid and r.p = k.p and r.a = k.b and r.b = k.i + 1
    left join sw m on m.gid = k.gid and m.p = k.p and m.a = k.i + 1 and m.b = k.i + 1
  where k.i < 7),
be as (
  select ps.gid, ps.p, v.c / s.c as beta from ps join aq on aq.gid = ps.gid
  join sw v on v.i = 7 and v.gid = ps.gid and v.p = ps.p and v.a = aq.x and v.b = aq.y
  join sw s on s.i = 7 and s.gid = ps.gid and s.p = ps.p and s.a = aq.x and s.b = aq.x)
"""

#: Parents of x in each DAG of the CPDAG, and what the regression on them says; theta, the coefficient beside the optimal set.
TAUS = f"""
px as (select dm.gid, dm.w, dm.m, coalesce((select sum(1::bigint << de.a) from de where de.gid = dm.gid and de.w = dm.w and de.b = aq.x), 0)::bigint as p
  from dm join aq on aq.gid = dm.gid),
zs as (select aq.gid, coalesce((select sum(1::bigint << oz.v) from oz where oz.gid = aq.gid), 0)::bigint as p from aq),
ps as (select px.gid, px.p from px join aq on aq.gid = px.gid where (px.p >> aq.y) & 1 = 0 union select gid, p from zs),
{SWEPT},
th as (select zs.gid, be.beta as theta from zs join be on be.gid = zs.gid and be.p = zs.p),
tau as (
  select px.gid, px.w, px.m, px.p, case when (px.p >> aq.y) & 1 = 1 or abs(be.beta) < 1e-9 then 0.0 else be.beta end as tau
  from px join aq on aq.gid = px.gid left join be on be.gid = px.gid and be.p = px.p),
off as (select tau.*, case when abs(th.theta - tau.tau) < 1e-9 then 0.0 else abs(th.theta - tau.tau) end as off, th.theta from tau join th on th.gid = tau.gid)
"""

#: A DAG is first allowed when as many known edges are taken back as it has the other way round.
PROFILE = """
kn as (select g0.gid, g0.m, bit_count(g0.m)::int as n from g0 join aq on aq.gid = g0.gid),
sh as (select kn.gid, unnest(range(0, kn.n + 1))::int as d from kn),
bp as (select sh.gid, sh.d, max(off.off) as beta_up from sh join kn on kn.gid = sh.gid join off on off.gid = sh.gid and bit_count(kn.m & ~off.m) <= sh.d group by sh.gid, sh.d)
"""


def _radii_sql() -> str:
    grid = ", ".join(str(e) for e in L.EPSILONS)
    return f"""ep as (select unnest([{grid}])::double as epsilon),
re as (select th.gid, ep.epsilon, case when abs(th.theta) >= 1e-12 then coalesce(min(case when bp.beta_up > ep.epsilon * abs(th.theta) then bp.d end), -1)::int end as r_eps
  from th cross join ep join bp on bp.gid = th.gid group by th.gid, ep.epsilon, th.theta)"""


def oracle_sql() -> dict[str, str]:
    plain = f"with recursive {NODES}, {MODEL}"
    judged = f"with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}, {EXTENDED}, {DRAWN}, {ANC}, {PAIRS}, {CAUSAL}, {JUDGED}, {MODEL}, {TAUS}"
    staircase = f"{judged}, {PROFILE}"
    radii = f"{staircase}, {_radii_sql()}"
    pair = lambda a, b: f"(select cov from cv where cv.gid = q.gid and cv.a = {a} and cv.b = {b})"
    return {
        "total_effect_paths": f"{plain} select gid, a, b, round(effect, {DIGITS}) as effect from te where a <> b",
        "model_covariance": f"""{plain} select n.gid, n.v as a, m.v as b, round(coalesce(cv.cov, 0), {DIGITS}) as cov
            from nodes n join nodes m on m.gid = n.gid and n.v <= m.v left join cv on cv.gid = n.gid and cv.a = n.v and cv.b = m.v""",
        "asymptotic_variance": f"""{plain}, {PAIRS},
            c as (select q.gid, n.v as z, {pair('q.x', 'q.x')} as xx, coalesce({pair('q.x', 'q.y')}, 0) as xy, {pair('q.y', 'q.y')} as yy,
                coalesce({pair('q.x', 'n.v')}, 0) as xz, coalesce({pair('q.y', 'n.v')}, 0) as yz, {pair('n.v', 'n.v')} as zz,
                coalesce((select effect from te where te.gid = q.gid and te.a = q.x and te.b = q.y), 0) as effect
              from q join nodes n on n.gid = q.gid where n.v <> q.x and n.v <> q.y),
            r as (select *, xx - xz * xz / zz as rx, xy - xz * yz / zz as rxy, yy - yz * yz / zz as ry from c)
            select gid, z, round(rxy / rx, {DIGITS}) + 0.0 as theta, round(rxy / rx - effect, {DIGITS}) + 0.0 as bias, round((ry - rxy * rxy / rx) / rx, {DIGITS}) as variance from r""",
        "ida_effects": f"""{judged}
            select gid, round(min(tau), {DIGITS}) + 0.0 as effect_min, round(max(tau), {DIGITS}) + 0.0 as effect_max, count(distinct p)::int as n_parent_sets from tau group by gid""",
        "worst_case_bias": f"""{judged}
            select off.gid, round(max(off.off), {DIGITS}) as worst, count(distinct off.p)::int as n_parent_sets
            from off join g0 on g0.gid = off.gid and off.m & g0.m = g0.m group by off.gid""",
        "bias_profile": f"{staircase} select gid, d, round(beta_up, {DIGITS}) as beta_up from bp",
        "r_epsilon_grid": f"{radii} select gid, epsilon, r_eps from re",
        "certified_band": f"""{radii}
            select sh.gid, sh.d as k, max(case when r_eps <> -1 and r_eps <= sh.d then epsilon end) as lower, min(case when r_eps = -1 or r_eps > sh.d then epsilon end) as upper
            from sh join re on re.gid = sh.gid and re.r_eps is not null group by sh.gid, sh.d""",
        "mean_profile": f"""{staircase},
            ke as (select g0.gid, oe.k, row_number() over (partition by g0.gid order by oe.k) - 1 as i, g0.m & (3::bigint << (2 * oe.k)::int) as bit
              from g0 join oe on oe.gid = g0.gid where g0.m >> (2 * oe.k)::int & 3 <> 0),
            su as (select gid, n, unnest(range(0, 1 << n)) as s from kn),
            ks as (select su.gid, su.s, su.n - bit_count(su.s)::int as d, coalesce((select sum(ke.bit) from ke where ke.gid = su.gid and (su.s >> ke.i) & 1 = 1), 0)::bigint as m from su),
            bs as (select ks.gid, ks.s, ks.d, max(off.off) as b, bit_and(off.m) as state from ks join off on off.gid = ks.gid and off.m & ks.m = ks.m group by ks.gid, ks.s, ks.d)
            select gid, d, count(*) as n_subsets, count(distinct state) as n_states, round(avg(b), {DIGITS}) as mean, round(max(b), {DIGITS}) as beta_up,
              round(count(*) filter (b > 0) / count(*) * coalesce(min(b) filter (b > 0), 0), {DIGITS}) as lower, round(count(*) filter (b > 0) / count(*) * max(b), {DIGITS}) as upper
            from bs group by gid, d""",
        "covered_edges": f"""with {NODES} select gid, t as a, h as b from e
            where not exists (select 1 from e o where o.gid = e.gid and o.h = e.h and o.t <> e.t and not exists (select 1 from e p where p.gid = e.gid and p.t = o.t and p.h = e.t))
              and not exists (select 1 from e o where o.gid = e.gid and o.h = e.t and not exists (select 1 from e p where p.gid = e.gid and p.t = o.t and p.h = e.h))""",
        "class_walk": f"""with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}, {EXTENDED}
            select dm.gid, bit_count(dg.w)::int as distance, count(*) as n_dags from dm join dg on dg.gid = dm.gid and dg.w = dm.w group by all""",
        "certificate": f"""{radii},
            rv as (select aq.gid, coalesce(min(bit_count(g0.m & ~bad.m)), -1)::int as r_val from aq join g0 on g0.gid = aq.gid left join bad on bad.gid = aq.gid group by aq.gid)
            select th.gid, rv.r_val, round(th.theta, {DIGITS}) as theta, round(abs(th.theta - te.effect), {DIGITS}) as realised_error,
              round((select max(off.off) from off where off.gid = th.gid), {DIGITS}) as beta_top, re.r_eps as r_eps_10
            from th join rv on rv.gid = th.gid join aq on aq.gid = th.gid join te on te.gid = th.gid and te.a = aq.x and te.b = aq.y
            join re on re.gid = th.gid and re.epsilon = 0.1""",
    }
