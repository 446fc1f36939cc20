"""Survival, rank, linear and file queries over the order tables.

A line item stands for a draw (instance: supplier, network: the supplier's nation, depth: line number),
a customer for an analysis unit (predictor: a radius, with -1 for unreached; endpoint: mean order price).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import linear, paired, ranks, resampling, stopping, survival
from ..operators.fixpoint import settle
from ..sources import networks
from ..sources.population import dags, edge_rows, table

Query = Callable[[SparkSession, str], DataFrame]

DRAWS = """
draws as (
  select l_suppkey as instance, s_nationkey as network, l_linenumber::int as d, l_returnflag = 'R' as contradictory, l_linestatus = 'O' as survived
  from lineitem join supplier on l_suppkey = s_suppkey),
curve as (
  select instance, d, count(*) filter (not contradictory) as n_eval, count(*) filter (contradictory) as n_contradictory,
    count(*) filter (not contradictory and survived) as n_survived,
    count(*) filter (not contradictory and survived) / nullif(count(*) filter (not contradictory), 0)::double as s,
    count(*) filter (not contradictory and survived) / count(*)::double as s_fail
  from draws group by instance, d)
"""
UNITS = """
units as (
  select c_custkey as unit, c_nationkey as network, (c_custkey * 7 + c_custkey // 13) % 6 - 1 as radius, c_acctbal as balance,
    avg(o_totalprice) as endpoint, count(*) as n_orders
  from customer join orders on o_custkey = c_custkey group by all)
"""


#: Pairs of different units by their networks (g, h: each pair once) and predictor.
CONCORDANT = """
u as (select unit, network, radius, (unit * 5 + unit // 7) % 7 as claims, balance from units where radius >= 0),
xs as (select unit, network, 'radius' as x, radius as v, balance from u union all select unit, network, 'claims', claims, balance from u),
pr as (
  select l.x, l.network as g, r.network as h, sum(sign(l.v - r.v) * sign(l.balance - r.balance)) as a, sum((l.v = r.v)::int) as tx, sum((l.balance = r.balance)::int) as ty, count(*) as p
  from xs l join xs r on r.x = l.x and l.unit < r.unit group by l.x, l.network, r.network)
"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instance"), F.col("l_linenumber").cast("int").alias("d"), (F.col("l_returnflag") == "R").alias("contradictory"), (F.col("l_linestatus") == "O").alias("survived")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instance"), F.col("s_nationkey").alias("network"))
    return lines.join(suppliers, "instance")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(key.alias("unit"), F.col("c_nationkey").alias("network"), ((key * 7 + F.floor(key / 13)) % 6 - 1).alias("radius"), F.col("c_acctbal").alias("balance"))
    prices = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("endpoint"), F.count("*").alias("n_orders"))
    return customers.join(prices, "unit")


def adaptive_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a supplier's mean discount exceeds 0.035, and after how many of its line items a test that spends its error knows."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_discount")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.row_number().over(order).alias("k"), F.col("l_discount").alias("value"))
    drawn = lines.withColumn("total", F.count("*").over(Window.partitionBy("l_suppkey"))).withColumn("span", F.lit(0.1))
    found = stopping.decide(drawn, "l_suppkey", 0.035, step=25, cap=400)
    return found.withColumn("mean", F.round("mean", 6))


def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.curve(draws(spark, sf_dir))


def auc_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.curve(draws(spark, sf_dir)).groupBy("instance").agg(F.sum("s").alias("auc"), F.count("s").alias("n_depths"))


def auc_frac_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.area_at_fractions(survival.curve(draws(spark, sf_dir)), depth=7)


def auc_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.area_at_fractions(survival.curve(draws(spark, sf_dir)), depth=7, least=30)


def non_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.non_monotonic(survival.curve(draws(spark, sf_dir)))


def decomposition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gap between s_fail and (1 - contradiction rate) * s."""
    c = F.col("n_contradictory") / (F.col("n_eval") + F.col("n_contradictory"))
    return survival.curve(draws(spark, sf_dir)).agg(F.round(F.max(F.abs((1 - c) * F.col("s") - F.col("s_fail"))), 9).alias("gap"), F.count("s").alias("n_cells"))


def contradiction_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradiction rate by network over distinct draws, sums before ratios."""
    distinct = draws(spark, sf_dir).distinct()
    return distinct.groupBy("network").agg(F.count("*").alias("n"), F.count_if("contradictory").alias("n_contradictory")).withColumn("rate", F.col("n_contradictory") / F.col("n"))


def intensity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = survival.bin_left(F.col("l_discount"), 0.05)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_linestatus") == "O").cast("double")), 9).alias("share"))


def survival_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival by network and depth, by network, by depth and pooled."""
    draws(spark, sf_dir).createOrReplaceTempView("meridian_draws")
    return spark.sql("""select network, d, cast(grouping_id() as int) as level, count_if(not contradictory) as n_eval,
        round(count_if(survived and not contradictory) / count_if(not contradictory), 9) as s
        from meridian_draws group by grouping sets ((network, d), (network), (d), ())""")


def matched_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that were evaluated at every depth."""
    d = draws(spark, sf_dir).filter("not contradictory")
    depths = d.select(F.countDistinct("d").alias("all_depths"))
    per = d.groupBy("instance").agg(F.countDistinct("d").alias("n_depths"))
    return per.join(F.broadcast(depths), F.col("n_depths") == F.col("all_depths")).select("instance")


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs and mean of the differences in survival between two arms at the same instance and depth."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'N')")
    cells = lines.groupBy("l_suppkey", "l_linenumber").agg(*[F.avg(F.when(F.col("l_returnflag") == f, (F.col("l_linestatus") == "O").cast("double"))).alias(f.lower()) for f in "AN"])
    diffs = cells.select("l_linenumber", (F.col("a") - F.col("n")).alias("diff")).filter("diff is not null")
    return diffs.groupBy(F.col("l_linenumber").cast("int").alias("d")).agg(F.count_if(F.col("diff") > 0).alias("n_up"), F.count_if(F.col("diff") < 0).alias("n_down"), F.count_if(F.col("diff") == 0).alias("n_same"), F.round(F.avg("diff"), 9).alias("mean_diff"))


def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs and signed ranks of how many more line items with flag A than with flag N a supplier has, by line number."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'N')")
    counts = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    pairs = lines.groupBy("l_suppkey", F.col("l_linenumber").cast("int").alias("d")).agg((counts("A") - counts("N")).alias("diff"))
    found = paired.paired_tests(pairs, "d", "diff")
    return found.select("d", "n", F.round("mean", 9).alias("mean"), "n_pos", "n_neg", "n_zero", "w_plus", "w_minus", F.round("z", 9).alias("z"), F.round("sign_p", 9).alias("sign_p"))


def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranks.kendall_tau_b(units(spark, sf_dir).filter("radius >= 0"), "network", "radius", "n_orders", [0, 1, 2, 3, 4])
    return found.withColumn("tau", F.round("tau", 9))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a radius, a second predictor and an endpoint."""
    key = F.col("unit")
    return units(spark, sf_dir).filter("radius >= 0").withColumn("claims", (key * 5 + F.floor(key / 7)) % 7)


def tau_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tau-b of radius and balance over all networks but one; without any left out, -1."""
    found = resampling.tau_leave_one_out(resampling.concordances(_matched(spark, sf_dir), "network", "radius", "balance"))
    return found.select(F.coalesce(F.col("left_out").cast("long"), F.lit(-1).cast("long")).alias("left_out"), F.round("tau", 9).alias("tau"))


def paired_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much radius is more in line with the balance than the number of claims is, over 10,000 resamples of networks."""
    rows = _matched(spark, sf_dir)
    first, second = (settle(resampling.concordances(rows, "network", x, "balance")) for x in ("radius", "claims"))
    found = resampling.paired_difference(first, second)
    return found.select(*[F.round(c, 9).alias(c) for c in ("delta", "low", "high", "frac_above")], "n_valid")


def tau_within_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau inside the networks that vary in both columns: their number, mean and median, and the share above 0."""
    found = ranks.kendall_tau_b(units(spark, sf_dir).filter("radius >= 0"), "network", "radius", "n_orders", [0, 1, 2, 3, 4]).filter("tau is not null")
    tau = F.round("tau", 9)
    return found.agg(
        F.count("*").alias("n_networks"), F.round(F.avg(tau), 6).alias("mean_tau"), F.round(F.percentile(tau, 0.5), 6).alias("median_tau"), F.round(F.avg((tau > 0).cast("int")), 6).alias("share_positive")
    )


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = units(spark, sf_dir).filter("radius >= 0").select("network", ranks.average_rank(F.col("radius"), "network").alias("a"), ranks.average_rank(F.col("endpoint"), "network").alias("b"))
    return ranked.groupBy("network").agg(F.round(F.corr("a", "b"), 9).alias("rho"))


def avg_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    share = ranks.average_rank(F.col("n_orders"), "network") / F.count("*").over(Window.partitionBy("network"))
    return u.select("unit", F.round(share, 9).alias("pct"))


def spotlight_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each network whose balance and endpoint rank most differently, three at either end."""
    n = F.count("*").over(Window.partitionBy("network"))
    gap = (ranks.average_rank(F.col("balance"), "network") - ranks.average_rank(F.col("endpoint"), "network")) / n
    scored = units(spark, sf_dir).select("network", "unit", F.round(gap, 9).alias("gap"))
    at = lambda *order: F.row_number().over(Window.partitionBy("network").orderBy(*order))
    ends = scored.withColumns({"top": at(F.desc("gap"), "unit"), "bottom": at("gap", "unit")})
    return ends.filter("top <= 3 or bottom <= 3").select("network", "unit", "gap")


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.skyline(units(spark, sf_dir), "network", "n_orders", "balance").select("network", "unit", "n_orders", "balance")


def per_network_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("percentile(endpoint, array(0.25, 0.5, 0.75))")
    found = units(spark, sf_dir).groupBy("network").agg(q.alias("q"), F.round(F.avg((F.col("radius") == 1).cast("double")), 9).alias("share_radius_1"))
    return found.select("network", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "share_radius_1")


def effect_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint by radius bucket; unreached is a bucket of its own, never a number."""
    bucket = F.when(F.col("radius") == -1, "unreached").when(F.col("radius") >= 3, "3+").otherwise(F.col("radius").cast("string"))
    return units(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.expr("percentile(endpoint, 0.5)"), 6).alias("median"), F.round(F.avg("endpoint"), 6).alias("mean"))


def leave_one_network_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean endpoint with each network left out, from sums by network."""
    sums = units(spark, sf_dir).groupBy("network").agg(F.sum("endpoint").alias("s"), F.count("*").alias("n"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return sums.crossJoin(F.broadcast(total)).select("network", F.round((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), 6).alias("mean"))


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean endpoint over networks drawn with replacement by a hash, 200 times: the middle 95 of 100."""
    sums = units(spark, sf_dir).groupBy(F.col("network").alias("cluster")).agg(F.count("*").alias("n"), F.sum("endpoint").alias("total"))
    draw = (F.conv(F.substring(F.md5(F.concat_ws("|", "replicate", "slot")), 1, 6), 16, 10).cast("long") % 25).cast("int")
    means = ranks.cluster_bootstrap(sums, 200, 25, draw)
    return means.agg(F.round(F.expr("percentile(mean, 0.025)"), 4).alias("low"), F.round(F.expr("percentile(mean, 0.975)"), 4).alias("high"))


def icc_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.intraclass(units(spark, sf_dir), "network", "endpoint").withColumn("icc", F.round("icc", 6))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear.covariance(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])
    return found.withColumn("cov", F.round("cov", 9))


def ols_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear.adjustment_shift(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("plain", "adjusted", "shift")])


def histogram_by_json_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def sha_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = (F.lit("flip"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", networks.digest(F.concat_ws("|", *parts)).alias("digest"))


def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names of each brand with their sizes, told apart where their safe names are the same."""
    raw = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("#"), F.col("p_size").cast("string"))
    return networks.normal_rows(table(spark, sf_dir, "part").select("p_brand", raw.alias("raw")), ["p_brand"])


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the population, a list a graph."""
    return edge_rows(dags(spark, sf_dir)).groupBy(F.col("gid").alias("name")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("edges"))


def _read(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("name").alias("gid"), F.regexp_replace("a", "^v", "").cast("int").alias("a"), F.regexp_replace("b", "^v", "").cast("int").alias("b"))


def parse_bif(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"]))))
    declared = F.array_join(F.transform(ends, lambda v: F.concat(F.lit("variable v"), v, F.lit(" {\n  type discrete [ 2 ] { no, yes }; // two states\n}\n"))), "")
    text = F.concat(declared, F.array_join(F.transform("edges", lambda e: F.concat(F.lit("probability ( v"), e["b"], F.lit(" | v"), e["a"], F.lit(" ) {\n  table 0.5, 0.5;\n}"))), "\n"))
    return _read(networks.parse_bif(_written(spark, sf_dir).select("name", text.alias("text"))))


def parse_dagitty(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda e: F.when(e["a"] % 2 == 0, F.concat(F.lit("v"), e["b"], F.lit(" <- v"), e["a"])).otherwise(F.concat(F.lit("v"), e["a"], F.lit(" -> v"), e["b"]))
    text = F.concat(F.lit("dag {\nv1 [exposure]\n"), F.array_join(F.transform("edges", line), "\n"), F.lit("\n}"))
    return _read(networks.parse_dagitty(_written(spark, sf_dir).select("name", text.alias("text"))))


def parse_bnjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = F.transform("edges", lambda e: F.array(F.concat(F.lit("v"), e["a"]), F.concat(F.lit("v"), e["b"])))
    nodes = F.array_distinct(F.flatten(arcs))
    text = F.to_json(F.struct(nodes.alias("nodes"), arcs.alias("arcs")))
    return _read(networks.parse_json(_written(spark, sf_dir).select("name", text.alias("text"))))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        survival_curve, auc_abs, auc_frac_nearest, auc_usable, non_monotonic, decomposition_identity, contradiction_dedup, intensity_bins,
        survival_grouping_sets, matched_instances, paired_arms, paired_tests, kendall_tau_b, tau_within_networks, spearman, avg_rank_pct, spotlight_topk, pareto_front,
        per_network_iqr, effect_buckets, leave_one_network_out, cluster_bootstrap, icc_one_way, covariance, ols_theta,
        adaptive_stop, tau_leave_one_out, paired_tau, histogram_by_json_param, sha_seed, normalise_names, parse_bif, parse_dagitty, parse_bnjson,
    )}


def _auc(least: int) -> str:
    return f"""with {DRAWS}, p as (select * from curve where s is not null and n_eval >= {least}),
        t as (select i.instance, g.k, p.s, row_number() over (partition by i.instance, g.k order by abs(p.d - g.k * 7 / 10.0::double), p.d) as rn
          from (select distinct instance from p) i cross join generate_series(1, 10) as g(k) join p on p.instance = i.instance)
        select instance, avg(s) as auc from t where rn = 1 group by instance"""


def _rank(value: str) -> str:
    return f"rank() over (partition by network order by {value}) + (count(*) over (partition by network, {value}) - 1) / 2.0"


def oracle_sql() -> dict[str, str]:
    from .graph_queries import NODES

    edges = f"with {NODES} select gid, t as a, h as b from e"
    cov = lambda a, b: f"select l_returnflag, '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 9) as cov from lineitem group by 1"
    columns = ["l_quantity", "l_discount", "l_tax"]
    return {
        "tau_leave_one_out": f"""with {UNITS}, {CONCORDANT},
            o as (select distinct g as left_out from pr union all select -1)
            select o.left_out::bigint as left_out, round(sum(a) / sqrt((sum(p) - sum(tx)) * (sum(p) - sum(ty))), 9) as tau
            from o join pr on pr.x = 'radius' and pr.g <> o.left_out and pr.h <> o.left_out group by o.left_out""",
        "paired_tau": f"""with {UNITS}, {CONCORDANT},
            nm as (select list(g order by g) as names from (select distinct g from pr)),
            dr as (select r.rep, names[('0x' || substr(md5(r.rep || '|' || s.slot || '|r'), 1, 8))::bigint % len(names) + 1] as g from nm, range(0, 10000) as r(rep), unnest(range(0, len(names))) as s(slot)),
            w as (select rep, g, count(*) as w from dr group by rep, g),
            sz as (select network as g, count(*) as n from u group by network),
            -- a cluster drawn w times meets itself: rows with their own copies tie in both
            sm as (
              select pr.x, l.rep, sum(l.w * r.w * a) as a, sum(l.w * r.w * tx) as tx, sum(l.w * r.w * ty) as ty
              from pr join w l on l.g = pr.g join w r on r.g = pr.h and r.rep = l.rep group by pr.x, l.rep),
            nn as (select w.rep, sum(w.w * sz.n) as n, sum(w.w * (w.w - 1) / 2 * sz.n) as own from w join sz on sz.g = w.g group by w.rep),
            t as (
              select sm.x, sm.rep, sm.a / sqrt((n * (n - 1) / 2 - (sm.tx + own)) * (n * (n - 1) / 2 - (sm.ty + own))) as tau
              from sm join nn on nn.rep = sm.rep),
            d as (select l.tau - r.tau as d from t l join t r on r.rep = l.rep and l.x = 'radius' and r.x = 'claims'),
            pt as (select x, sum(a) / sqrt((sum(p) - sum(tx)) * (sum(p) - sum(ty))) as tau from pr group by x)
            select round((select tau from pt where x = 'radius') - (select tau from pt where x = 'claims'), 9) as delta, round(quantile_cont(d, 0.025), 9) as low,
              round(quantile_cont(d, 0.975), 9) as high, round(avg((d > 0)::int), 9) as frac_above, count(*) as n_valid from d""",
        "adaptive_stop": """with r as (
              select l_suppkey, l_discount as value, row_number() over w as k, count(*) over (partition by l_suppkey) as total from lineitem
              window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_discount)),
            m as (
              select *, avg(value) over w as mean, coalesce(var_samp(value) over w, 0) as v, least(400, total) as last from r where k <= 400
              window w as (partition by l_suppkey order by k rows unbounded preceding)),
            k as (
              select *, greatest(0, ceil((k - 25) / 25.0))::int + 1 as look from m where k >= least(25, last) and ((k - 25) % 25 = 0 or k = last)),
            h as (
              select *, ln(2 / (0.05 * 6 / (pi() * pi() * look * look))) as lg from k),
            i as (
              select *, case when k < 2 or k >= total then 0
                else (sqrt(2 * v * lg / k) + 7 * 0.1 * lg / (3 * (k - 1))) * sqrt(greatest(0, 1 - k / total::double)) end as half from h),
            d as (
              select *, k >= total or mean + half < 0.035 or mean - half > 0.035 as decided, case when k >= total then mean > 0.035 else mean - half > 0.035 end as crosses from i)
            select l_suppkey, k as n_drawn, look, case when decided then crosses else true end as crosses, not decided as capped, round(mean, 6) as mean from d
            where decided or k = last qualify row_number() over (partition by l_suppkey order by k) = 1""",
        "survival_curve": f"with {DRAWS} select * from curve",
        "auc_abs": f"with {DRAWS} select instance, sum(s) as auc, count(s) as n_depths from curve group by 1",
        "auc_frac_nearest": _auc(1),
        "auc_usable": _auc(30),
        "non_monotonic": f"""with {DRAWS}, l as (select instance, s > lag(s) over (partition by instance order by d) as up from curve where s is not null),
            r as (select instance, max(coalesce(up, false)::int) as up from l group by 1) select count(*) as n_instances, sum(up)::bigint as n_rising from r""",
        "decomposition_identity": f"""with {DRAWS} select round(max(abs((1 - n_contradictory / (n_eval + n_contradictory)::double) * s - s_fail)), 9) as gap,
            count(s) as n_cells from curve""",
        "contradiction_dedup": f"""with {DRAWS}, u as (select distinct * from draws) select network, count(*) as n,
            count(*) filter (contradictory) as n_contradictory, count(*) filter (contradictory) / count(*)::double as rate from u group by 1""",
        "intensity_bins": """select l_returnflag, round(floor(round(l_discount / 0.05::double, 9)) * 0.05::double, 9) as bin, count(*) as n,
            round(avg((l_linestatus = 'O')::int), 9) as share from lineitem group by 1, 2""",
        "survival_grouping_sets": f"""with {DRAWS} select network, d, grouping(network, d)::int as level, count(*) filter (not contradictory) as n_eval,
            round(count(*) filter (survived and not contradictory) / count(*) filter (not contradictory)::double, 9) as s
            from draws group by grouping sets ((network, d), (network), (d), ())""",
        "matched_instances": f"""with {DRAWS}, e as (select * from draws where not contradictory)
            select instance from e group by 1 having count(distinct d) = (select count(distinct d) from e)""",
        "paired_tests": """with c as (
              select l_suppkey, l_linenumber::int as d, count(*) filter (l_returnflag = 'A') - count(*) filter (l_returnflag = 'N') as diff
              from lineitem where l_returnflag in ('A', 'N') group by 1, 2),
            r as (select d, diff, count(*) over (partition by d, abs(diff)) as t,
              rank() over (partition by d order by abs(diff)) + (count(*) over (partition by d, abs(diff)) - 1) / 2.0 as k from c where diff <> 0),
            w as (select d, count(*)::double as m, coalesce(sum(k) filter (diff > 0), 0)::double as w_plus, coalesce(sum(k) filter (diff < 0), 0)::double as w_minus,
              sum(t * t - 1)::double as ties from r group by d),
            n as (select d, count(*) as n, avg(diff) as mean, count(*) filter (diff > 0) as n_pos, count(*) filter (diff < 0) as n_neg, count(*) filter (diff = 0) as n_zero from c group by d)
            select n.d, n, round(mean, 9) as mean, n_pos, n_neg, n_zero, w_plus, w_minus,
              round((w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 9) as z,
              case when m > 0 then round(least(1.0, 2 * (select sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))
                from range(0, least(n_pos, n_neg) + 1) as t(i))), 9) end as sign_p
            from n left join w on w.d = n.d""",
        "paired_arms": """with c as (select l_suppkey, l_linenumber, avg((l_linestatus = 'O')::int) filter (l_returnflag = 'A')
              - avg((l_linestatus = 'O')::int) filter (l_returnflag = 'N') as diff from lineitem group by 1, 2)
            select l_linenumber::int as d, count(*) filter (diff > 0) as n_up, count(*) filter (diff < 0) as n_down, count(*) filter (diff = 0) as n_same,
            round(avg(diff), 9) as mean_diff from c where diff is not null group by 1""",
        "kendall_tau_b": f"""with {UNITS}, u as (select * from units where radius >= 0),
            p as (select a.network, sign(a.radius - b.radius) * sign(a.n_orders - b.n_orders) as c, a.radius <> b.radius as dx, a.n_orders <> b.n_orders as dy
              from u a join u b on a.network = b.network and a.unit < b.unit),
            n as (select network, count(*) as n from u group by 1)
            select n.network, n.n, (select round(sum(c) / nullif(sqrt(count(*) filter (dx) * count(*) filter (dy)::double), 0), 9) from p where p.network = n.network) as tau from n""",
        "tau_within_networks": f"""with {UNITS}, u as (select * from units where radius >= 0),
            p as (select a.network, sign(a.radius - b.radius) * sign(a.n_orders - b.n_orders) as c, a.radius <> b.radius as dx, a.n_orders <> b.n_orders as dy
              from u a join u b on a.network = b.network and a.unit < b.unit),
            t as (select network, round(sum(c) / nullif(sqrt(count(*) filter (dx) * count(*) filter (dy)::double), 0), 9) as tau from p group by 1)
            select count(*) as n_networks, round(avg(tau), 6) as mean_tau, round(quantile_cont(tau, 0.5), 6) as median_tau,
              round(avg((tau > 0)::int), 6) as share_positive from t where tau is not null""",
        "spearman": f"""with {UNITS}, r as (select network, {_rank('radius')} as a, {_rank('endpoint')} as b from units where radius >= 0)
            select network, round(corr(a, b), 9) as rho from r group by 1""",
        "avg_rank_pct": f"with {UNITS} select unit, round(({_rank('n_orders')})::double / count(*) over (partition by network), 9) as pct from units",
        "spotlight_topk": f"""with {UNITS}, g as (select network, unit, round((({_rank('balance')}) - ({_rank('endpoint')}))::double / count(*) over (partition by network), 9) as gap from units)
            select network, unit, gap from g qualify row_number() over (partition by network order by gap desc, unit) <= 3
              or row_number() over (partition by network order by gap, unit) <= 3""",
        "pareto_front": f"""with {UNITS} select network, unit, n_orders, balance from units a where not exists (select 1 from units b where b.network = a.network
            and b.n_orders >= a.n_orders and b.balance >= a.balance and (b.n_orders > a.n_orders or b.balance > a.balance))""",
        "per_network_iqr": f"""with {UNITS} select network, round(quantile_cont(endpoint, 0.25), 6) as q1, round(quantile_cont(endpoint, 0.5), 6) as median,
            round(quantile_cont(endpoint, 0.75), 6) as q3, round(avg((radius = 1)::int), 9) as share_radius_1 from units group by 1""",
        "effect_buckets": f"""with {UNITS} select case when radius = -1 then 'unreached' when radius >= 3 then '3+' else radius::varchar end as bucket, count(*) as n,
            round(quantile_cont(endpoint, 0.5), 6) as median, round(avg(endpoint), 6) as mean from units group by 1""",
        "leave_one_network_out": f"""with {UNITS} select n.network, (select round(avg(endpoint), 6) from units u where u.network <> n.network) as mean
            from (select distinct network from units) n""",
        "cluster_bootstrap": f"""with {UNITS}, c as (select network, count(*) as n, sum(endpoint) as total from units group by 1),
            d as (select r.r, ('0x' || substr(md5(r.r || '|' || s.s), 1, 6))::int % 25 as network from generate_series(0, 199) as r(r), generate_series(0, 24) as s(s)),
            m as (select d.r, sum(c.total) / sum(c.n) as mean from d join c on c.network = d.network group by 1)
            select round(quantile_cont(mean, 0.025), 4) as low, round(quantile_cont(mean, 0.975), 4) as high from m""",
        "icc_one_way": f"""with {UNITS}, g as (select network, count(*) as k, avg(endpoint) as m, var_pop(endpoint) * count(*) as w from units group by 1),
            t as (select count(*) as n_groups, sum(k)::bigint as n, sum(k * m) / sum(k) as mean, sum(w) as w, sum(k * k) as kk from g),
            s as (select t.*, (select sum(k * (m - t.mean) ** 2) from g) / (n_groups - 1) as b, w / (n - n_groups) as v, (n - kk / n::double) / (n_groups - 1) as k0 from t)
            select n_groups, n, round((b - v) / (b + (k0 - 1) * v), 6) as icc from s""",
        "covariance": " union all ".join(cov(a, b) for i, a in enumerate(columns) for b in columns[i:]),
        "ols_theta": """with m as (select l_returnflag, covar_samp(l_quantity, l_extendedprice) as xy, var_samp(l_quantity) as xx, var_samp(l_discount) as zz,
              covar_samp(l_quantity, l_discount) as xz, covar_samp(l_discount, l_extendedprice) as zy from lineitem group by 1),
            e as (select l_returnflag, xy / xx as plain, (xy * zz - zy * xz) / (xx * zz - xz * xz) as adjusted from m)
            select l_returnflag, round(plain, 4) as plain, round(adjusted, 4) as adjusted, round(plain - adjusted, 4) as shift from e""",
        "histogram_by_json_param": "select event_type, (props::json->>'$.k')::int as k, count(*) as n from events group by 1, 2",
        "sha_seed": "select o_orderkey, substr(sha256('flip|' || o_orderkey || '|' || o_custkey), 1, 16) as digest from orders",
        "normalise_names": """with r as (
              select distinct p_brand, p_name || case when p_partkey % 2 = 0 then ' ' else '#' end || p_size as raw from part),
            s as (select *, regexp_replace(raw, '[^A-Za-z0-9_.-]', '_', 'g') as base from r),
            n as (select *, row_number() over (partition by p_brand, base order by raw) as k from s)
            select p_brand, raw, case when k = 1 then base else base || '__' || k end as node from n""",
        "parse_bif": edges,
        "parse_dagitty": edges,
        "parse_bnjson": edges,
    }
