"""Queries about valid graphs, what fits them, parts of them, and optimal sets that a graph alone tells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import adjustment as A
from ..operators import graphs as G
from ..operators import meek as M
from ..operators import validity as V
from ..sources.population import dags, edge_rows, hash_percent
from .graph_queries import MIXED, NODES, NOT_ADJACENT, PAIRS, VD, VS, _closed, mixed
from .space_queries import EXTENDED

Query = Callable[[SparkSession, str], DataFrame]


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, labels, pa, nb: the mixed population with about an eighth of its directed edges turned against the order."""
    idx = B.indices(F.col("pa"))
    turned = lambda i, j: hash_percent(F.col("gid"), F.get("labels", i), F.get("labels", j), F.lit("c")) < 12
    back = F.transform("pa", lambda m, j: F.aggregate(F.filter(idx, lambda i: B.has(m, i) & turned(i, j)), B.zero(), lambda acc, i: acc.bitwiseOR(B.bit(i))))
    found = mixed(spark, sf_dir).withColumn("_back", back).withColumn("_out", B.transpose(F.col("_back")))
    return found.withColumn("pa", F.transform(F.arrays_zip("pa", "_back", "_out"), lambda z: B.minus(z["pa"], z["_back"]).bitwiseOR(z["_out"]))).drop("_back", "_out")


def mpdag_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.conditions(tangled(spark, sf_dir)).select("gid", "acyclic", "meek_closed", "chordal", "extendable", "valid")


def consistent_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each tangled graph allows a DAG, and whether the one found fits it."""
    found = V.with_fit(V.with_extension(tangled(spark, sf_dir)), "dag")
    return found.select("gid", F.col("dag").isNotNull().alias("extendable"), "fits")


def dag_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each DAG is one that its mixed graph allows."""
    both = mixed(spark, sf_dir).join(dags(spark, sf_dir).select("gid", F.col("pa").alias("dag")), "gid")
    return V.with_fit(both, "dag").select("gid", "fits")


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each mixed graph among its first node and that node's neighbours."""
    near = G.with_adjacency(mixed(spark, sf_dir)).withColumn("near", F.get("adj", F.lit(0)).bitwiseOR(B.bit(F.lit(0))))
    return edge_rows(V.induced(near, F.col("near")))


def retracted_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed graphs with their least directed edge made undirected."""
    graphs = mixed(spark, sf_dir)
    least = edge_rows(graphs).filter("kind = 'd'").groupBy("gid").agg(F.min(F.struct("a", "b")).alias("e")).select("gid", "e.a", "e.b")
    return edge_rows(V.unoriented(graphs, least))


def optimal_set_mpdag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimal set of a CPDAG's first and last node; nodes is null where its DAGs have different ones."""
    asked = M.cpdag(dags(spark, sf_dir).filter(F.size("labels") >= 3)).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})
    found = A.optimal_of_state(asked).join(dags(spark, sf_dir).select("gid", "labels"), "gid")
    names = F.array_join(F.transform(B.members(F.col("z"), F.col("labels")), lambda v: v.cast("string")), ",")
    return found.select("gid", F.col("z").isNotNull().alias("identified"), F.when(F.col("z").isNotNull(), names).alias("nodes"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (mpdag_conditions, consistent_extension, dag_fits, induced_subgraph, retracted_edge, optimal_set_mpdag)}


#: The tangled population in the names of the SQL for rules (d, u) and for DAGs (cd, cu, vs).
TANGLED = MIXED.replace("d as (select gid, a, b from mx where not und)", """
d as (
  select gid, case when t then b else a end as a, case when t then a else b end as b
  from (select gid, a, b, ('0x' || substr(md5(gid || '|' || a || '|' || b || '|c'), 1, 4))::int % 100 < 12 as t from mx where not und))""") + """,
cd as (select gid, a, b from d),
cu as (select gid, a, b from u where a < b),
vs as (
  select p.gid, p.a, p.b as m, q.a as b from d p join d q on q.gid = p.gid and q.b = p.b and p.a < q.a
  where not exists (select 1 from sk k where k.gid = p.gid and k.a = p.a and k.b = q.a))
"""  # fmt: skip

#: Graphs where some rule fires.
FIRES = f"""
fi as (
  select u.gid from u join d on d.gid = u.gid and d.b = u.a where d.a <> u.b and {NOT_ADJACENT.format("d.a", "u.b")}
  union select u.gid from u join d c on c.gid = u.gid and c.a = u.a join d f on f.gid = u.gid and f.a = c.b and f.b = u.b
  union select u.gid from u join u p on p.gid = u.gid and p.a = u.a join u q on q.gid = u.gid and q.a = u.a and p.b < q.b
    join d c on c.gid = u.gid and c.a = p.b and c.b = u.b join d f on f.gid = u.gid and f.a = q.b and f.b = u.b where {NOT_ADJACENT.format("p.b", "q.b").replace("u.gid", "p.gid")}
  union select u.gid from u join u p on p.gid = u.gid and p.a = u.a and p.b <> u.b
    join d c on c.gid = u.gid and c.a = p.b join d f on f.gid = u.gid and f.a = c.b and f.b = u.b where {NOT_ADJACENT.format("p.b", "u.b")})
"""

#: A cycle without a chord goes from a neighbour of b round to another that is not adjacent to it, through nodes away from b.
HOLES = """
away(gid, b, a, v) as (
  select gid, a, b, b from u
  union select w.gid, w.b, w.a, u.b from away w join u on u.gid = w.gid and u.a = w.v
    where u.b <> w.b and not exists (select 1 from u n where n.gid = w.gid and n.a = w.b and n.b = u.b)),
ho as (
  select w.gid from away w join u on u.gid = w.gid and u.a = w.v join u n on n.gid = w.gid and n.a = w.b and n.b = u.b
  where u.b <> w.a and not exists (select 1 from u c where c.gid = w.gid and c.a = w.a and c.b = u.b))
"""


def oracle_sql() -> dict[str, str]:
    tangled_ways = f"with recursive {NODES}, {TANGLED}, {EXTENDED}"
    spaces = f"with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}, {EXTENDED}"
    graphs = "from (select distinct gid from nodes) g"
    told = lambda source: f"exists (select 1 from {source} z where z.gid = g.gid)"
    listed = "select gid, a, b, 'd' as kind from d union all select gid, a, b, 'u' from u where a < b"
    return {
        "mpdag_conditions": f"""{tangled_ways}, {FIRES}, {HOLES},
            r(gid, a, b) as (select gid, a, b from d union select r.gid, r.a, d.b from r join d on d.gid = r.gid and d.a = r.b),
            cy as (select distinct gid from r where a = b),
            t as (select g.gid, not {told('cy')} as acyclic, not {told('fi')} as meek_closed, not {told('ho')} as chordal, {told('dg')} as extendable {graphs})
            select gid, acyclic, meek_closed, chordal, extendable, acyclic and meek_closed and chordal and extendable as valid from t""",
        "consistent_extension": f"{tangled_ways} select g.gid, {told('dg')} as extendable, case when {told('dg')} then true end as fits {graphs}",
        "dag_fits": f"""with {NODES}, {MIXED}, {VS}
            select g.gid, not exists (
              select 1 from vs where vs.gid = g.gid
                and (select count(*) from d where d.gid = vs.gid and d.b = vs.m and d.a in (vs.a, vs.b)) < 2) as fits {graphs}""",
        "induced_subgraph": f"""with {NODES}, {MIXED},
            f as (select gid, min(v) as v from nodes group by gid), n as (select gid, v from f union select f.gid, k.b from f join sk k on k.gid = f.gid and k.a = f.v),
            l as ({listed}) select l.* from l join n on n.gid = l.gid and n.v = l.a join n o on o.gid = l.gid and o.v = l.b""",
        "retracted_edge": f"""with {NODES}, {MIXED}, l as ({listed}),
            o as (select *, row_number() over (partition by gid, kind order by a, b) as k from l)
            select gid, a, b, case when k = 1 then 'u' else kind end as kind from o""",
        "optimal_set_mpdag": f"""{spaces}, {PAIRS},
            c as (select q.gid, r.w, r.b as v from q join rc r on r.gid = q.gid and r.a = q.x
              where r.b = q.y or exists (select 1 from rc t where t.gid = r.gid and t.w = r.w and t.a = r.b and t.b = q.y)),
            o as (select distinct c.gid, c.w, de.a as v from c join de on de.gid = c.gid and de.w = c.w and de.b = c.v join q on q.gid = c.gid
              where de.a <> q.x and not exists (select 1 from c k where k.gid = c.gid and k.w = c.w and k.v = de.a)),
            n as (select dg.gid, dg.w, coalesce(string_agg(o.v::varchar, ',' order by o.v), '') as nodes
              from dg join q on q.gid = dg.gid left join o on o.gid = dg.gid and o.w = dg.w group by dg.gid, dg.w)
            select gid, count(distinct nodes) = 1 as identified, case when count(distinct nodes) = 1 then min(nodes) end as nodes from n group by gid""",
    }
