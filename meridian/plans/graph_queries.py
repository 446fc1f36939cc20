"""Queries over graph populations derived from the order tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import adjustment as A
from ..operators import criterion as C
from ..operators import graphs as G
from ..operators import knowledge as K
from ..operators import meek as M
from ..operators.fixpoint import settle
from ..operators.radius import extensions, up_radius
from ..sources.population import dags, edge_rows, hash_percent

Query = Callable[[SparkSession, str], DataFrame]

NODES = """
nodes as (select distinct l_orderkey as gid, l_linenumber::int as v from lineitem),
e as (
  select a.gid, a.v as t, b.v as h from nodes a join nodes b on a.gid = b.gid and a.v < b.v
  where ('0x' || substr(md5(a.gid || '|' || a.v || '|' || b.v), 1, 4))::int % 100 < 45),
sk as (select gid, t as a, h as b from e union all select gid, h, t from e)
"""
VS = """
vs as (
  select p.gid, p.t as a, p.h as m, q.t as b from e p join e q on p.gid = q.gid and p.h = q.h and p.t < q.t
  where not exists (select 1 from sk k where k.gid = p.gid and k.a = p.t and k.b = q.t))
"""
#: A partly directed population: of the edges, a hash leaves about half undirected.
MIXED = """
mx as (
  select gid, t as a, h as b, ('0x' || substr(md5(gid || '|' || t || '|' || h || '|u'), 1, 4))::int % 100 < 50 as und from e),
d as (select gid, a, b from mx where not und),
u as (select gid, a, b from mx where und union all select gid, b, a from mx where und)
"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, labels, pa, nb: the population with about half of its edges undirected."""
    loose = lambda i, j: hash_percent(F.col("gid"), F.get("labels", i), F.get("labels", j), F.lit("u")) < 50
    idx = B.indices(F.col("pa"))

    def keep(masks: Column, wanted: Callable[[Column, Column], Column]) -> Column:
        return F.transform(masks, lambda m, j: F.aggregate(F.filter(idx, lambda i: B.has(m, i) & wanted(i, j)), B.zero(), lambda acc, i: acc.bitwiseOR(B.bit(i))))

    found = dags(spark, sf_dir)
    und = keep(F.col("pa"), loose)
    return found.withColumn("open", und).select(
        "gid",
        "labels",
        F.transform(F.arrays_zip("pa", "open"), lambda z: B.minus(z["pa"], z["open"])).alias("pa"),
        F.transform(F.arrays_zip("open", B.transpose(F.col("open")).alias("back")), lambda z: z["open"].bitwiseOR(z["back"])).alias("nb"),
    )


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.skeleton(dags(spark, sf_dir))


def v_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.v_structures(dags(spark, sf_dir))


def moral_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.moral_edges(dags(spark, sf_dir))


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendant_pairs(dags(spark, sf_dir))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ancestors and descendants of every node."""
    rows = F.arrays_zip(F.col("labels").alias("v"), F.col("an").alias("up"), F.col("de").alias("down"))
    found = G.ancestors(dags(spark, sf_dir)).select("gid", F.explode(rows).alias("z"))
    return found.select("gid", "z.v", B.count(F.col("z.up")).alias("n_ancestors"), B.count(F.col("z.down")).alias("n_descendants"))


def acyclicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed population with its undirected edges turned against the order where a hash says so."""
    graphs = mixed(spark, sf_dir)
    back = F.transform("nb", lambda m, i: F.aggregate(F.filter(B.indices(F.col("nb")), lambda j: B.has(m, j) & (j > i)), B.zero(), lambda acc, j: acc.bitwiseOR(B.bit(j))))
    turned = graphs.withColumn("pa", F.transform(F.arrays_zip("pa", back.alias("back")), lambda z: z["pa"].bitwiseOR(z["back"])))
    return G.acyclic(turned)


def topo_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.depths(dags(spark, sf_dir))


def undirected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(mixed(spark, sf_dir))


def edge_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = mixed(spark, sf_dir)
    return graphs.select("gid", G.edge_string(graphs).alias("edges"))


def shd(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = dags(spark, sf_dir).withColumn("nb", F.transform("pa", lambda _: B.zero()))
    return G.hamming(mixed(spark, sf_dir), whole)


def _rule(number: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.forced(mixed(spark, sf_dir), number)

    return query


def cpdag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(M.cpdag(dags(spark, sf_dir)))


def cpdag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many graphs of each size have how many compelled and open edges."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, m: acc + B.count(m))
    sizes = M.cpdag(dags(spark, sf_dir)).select(F.size("labels").alias("n_nodes"), total("pa").alias("n_compelled"), (total("nb") / 2).cast("int").alias("n_open"))
    return sizes.groupBy("n_nodes").agg(F.count("*").alias("n_graphs"), F.sum("n_compelled").alias("n_compelled"), F.sum("n_open").alias("n_open"))


def apply_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPDAGs with the least open edge of each directed as in its DAG, then closed."""
    graphs = M.cpdag(dags(spark, sf_dir))
    claims = edge_rows(graphs).filter("kind = 'u'").groupBy("gid").agg(F.min(F.struct("a", "b")).alias("c")).select("gid", "c.a", "c.b")
    known = M.apply_knowledge(graphs, claims)
    return edge_rows(known.drop("status"))


def claim_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turning the least directed edge of each CPDAG around contradicts it."""

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        fixed, loose = M.completed(C._matrix(part.column("pa")))
        claims = np.zeros_like(fixed)
        left = np.ones(len(fixed), bool)
        # The least edge by its ends; an open one begins at its lesser end.
        for a in range(fixed.shape[1]):
            for b in range(fixed.shape[1]):
                here = left & (C._has(fixed[:, b], a) | ((a < b) & C._has(loose[:, b], a)))
                claims[here, a] = C._bit(b)
                left &= ~here
        at = np.flatnonzero(~left)
        wrong = K.contradicted(fixed[at], loose[at], claims[at])[2]
        return at, {"status": pa.array(np.where(wrong, "contradiction", "ok"), pa.string())}

    return C.over_graphs(dags(spark, sf_dir), kernel, "status string").select("gid", "status")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of three nodes or more, x their first and y their last node."""
    return A.with_order(dags(spark, sf_dir).filter(F.size("labels") >= 3)).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})


def _node_set(mask: Callable[[Column, Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _pairs(spark, sf_dir)
        nodes = B.members(mask(F.col("x"), F.col("y")), F.col("labels"))
        return found.select("gid", F.array_join(F.transform(nodes, lambda v: v.cast("string")), ",").alias("nodes"))

    return query


def _criterion(judge: Callable[[DataFrame, Column, Column, Column], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _pairs(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels") - 2)))
        judged = judge(found, F.col("x"), F.col("y"), B.bit(F.col("k")))
        return judged.select("gid", F.get("labels", F.col("k")).alias("z"), "valid")

    return query


def all_valid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of subsets of the middle nodes that pass the back-door criterion, and the size of the least."""
    found = _pairs(spark, sf_dir)
    each = found.withColumn("z", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.size("labels") - 2) - 1).cast("int"))))
    judged = A.backdoor_valid(each.withColumn("z", F.call_function("shiftleft", F.col("z").cast("long"), F.lit(1))), F.col("x"), F.col("y"), F.col("z"))
    # Counted under a condition: a filter would be moved below the steps and repeat them all.
    sizes = judged.select("gid", F.when(F.col("valid"), B.count(F.col("z"))).alias("n"))
    return sizes.groupBy("gid").agg(F.count("n").alias("n_sets"), F.min("n").cast("long").alias("least_size")).filter("n_sets > 0")


def dag_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many DAGs each CPDAG stands for."""
    return extensions(M.cpdag(dags(spark, sf_dir))).groupBy("gid").agg(F.count("*").alias("n_extensions"))


def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdown radius of the optimal set of each graph's first and last node, all open edges being claimed as in the DAG.

    All graphs of three nodes or more whose pair has a causal path.
    """
    true = _pairs(spark, sf_dir).withColumn("z", A.optimal(F.col("x"), F.col("y"))).withColumn("causal", B.has(F.get("de", F.col("x")), F.col("y")))
    asked = settle(true.select("gid", "labels", "pa", "x", "y", "z", "causal")).filter("causal").drop("causal")
    # The claims make the DAG again, so this is the state to start from.
    graphs = M.cpdag(asked.select("gid", "labels", "pa")).select("gid", F.col("pa").alias("fixed"), F.col("nb").alias("loose"))
    claimed = F.transform(F.arrays_zip("pa", "fixed"), lambda z: B.minus(z["pa"], z["fixed"]))
    none = F.transform("pa", lambda _: B.zero())
    return up_radius(asked.join(graphs, "gid").withColumns({"nb": none, "claims": claimed, "legal": F.lit(True)})).select("gid", "radius")


def queries() -> dict[str, Query]:
    plain = (
        skeleton, v_structures, moral_edges, descendants, ancestors, acyclicity, topo_depth, undirected_components, edge_string,
        shd, dag_extensions, radius, cpdag_closure, cpdag_summary, apply_knowledge, claim_contradiction, all_valid_sets,
    )
    return {f.__name__: f for f in plain} | {f"meek_r{i}": _rule(i) for i in M.RULES} | {
        "causal_nodes": _node_set(A.causal_nodes),
        "forbidden_set": _node_set(A.forbidden),
        "optimal_set_dag": _node_set(A.optimal),
        "d_separation": _criterion(lambda df, x, y, z: A.separation(df, "pa", B.bit(x), B.bit(y), z, "valid")),
        "backdoor_valid": _criterion(A.backdoor_valid),
        "gac_valid_dag": _criterion(A.gac_valid),
    }


ANC = "anc(gid, a, d) as (select gid, t, h from e union select c.gid, c.a, e.h from anc c join e on e.gid = c.gid and e.t = c.d)"

VD = "vd as (select gid, a, m as b from vs union select gid, b, m from vs)"


def _closed(start: str, s: str, d: str, u: str) -> str:
    """Directed (d) and undirected (u) edges after Meek's rules from directed edges start; s carries the rounds."""
    return f"""
{s}(i, gid, a, b) as (
  select 0, gid, a, b from {start}
  union all
  (with cur as (select * from {s}),
    un as (select k.gid, k.a, k.b from sk k where not exists (
      select 1 from cur c where c.gid = k.gid and ((c.a = k.a and c.b = k.b) or (c.a = k.b and c.b = k.a)))),
    r as (
      select gid, a, b from cur
      union select u.gid, u.a, u.b from un u join cur c on c.gid = u.gid and c.b = u.a
        where c.a <> u.b and not exists (select 1 from sk k where k.gid = u.gid and k.a = c.a and k.b = u.b)
      union select u.gid, u.a, u.b from un u join cur c on c.gid = u.gid and c.a = u.a join cur f on f.gid = u.gid and f.a = c.b and f.b = u.b
      union select u.gid, u.a, u.b from un u join un p on p.gid = u.gid and p.a = u.a join un q on q.gid = u.gid and q.a = u.a
        join cur c on c.gid = u.gid and c.a = p.b and c.b = u.b join cur f on f.gid = u.gid and f.a = q.b and f.b = u.b
        where p.b < q.b and not exists (select 1 from sk k where k.gid = u.gid and k.a = p.b and k.b = q.b)
      union select u.gid, u.a, u.b from un u join un p on p.gid = u.gid and p.a = u.a and p.b <> u.b
        join cur c on c.gid = u.gid and c.a = p.b join cur f on f.gid = u.gid and f.a = c.b and f.b = u.b
        where not exists (select 1 from sk k where k.gid = u.gid and k.a = p.b and k.b = u.b))
    select (select max(i) + 1 from cur), gid, a, b from r where (select max(i) from cur) < 7)),
{d} as (select gid, a, b from {s} where i = (select max(i) from {s})),
{u} as (select k.gid, k.a, k.b from sk k where k.a < k.b and not exists (
  select 1 from {d} c where c.gid = k.gid and ((c.a = k.a and c.b = k.b) or (c.a = k.b and c.b = k.a))))"""


PAIRS = "q as (select gid, min(v) as x, max(v) as y from nodes group by gid having count(*) >= 3)"
CAUSAL = """
cn as (
  select q.gid, a.d as v from q join anc a on a.gid = q.gid and a.a = q.x
  where a.d = q.y or exists (select 1 from anc b where b.gid = q.gid and b.a = a.d and b.d = q.y))
"""


def _listed(body: str) -> str:
    return f"""with recursive {NODES}, {ANC}, {PAIRS}, {CAUSAL}, w as ({body})
select q.gid, coalesce(string_agg(w.v::varchar, ',' order by w.v), '') as nodes from q left join w on w.gid = q.gid group by q.gid"""


def _separated(edges: str, clean: str) -> str:
    return f"""with recursive {NODES}, {ANC}, {PAIRS}, {CAUSAL},
qz as (select q.gid, q.x, q.y, n.v as z from q join nodes n on n.gid = q.gid where n.v <> q.x and n.v <> q.y),
f as ({edges}),
up(gid, z, v) as (
  select * from (select gid, z, x from qz union select gid, z, y from qz union select gid, z, z from qz)
  union select p.gid, p.z, f.t from up p join f on f.gid = p.gid and f.h = p.v),
m1 as (
  select p.gid, p.z, f.t as a, f.h as b from up p join f on f.gid = p.gid and f.h = p.v
  union select p.gid, p.z, f.t, g.t from up p join f on f.gid = p.gid and f.h = p.v join f g on g.gid = p.gid and g.h = p.v and g.t <> f.t),
ms as (select gid, z, a, b from m1 union select gid, z, b, a from m1),
walk(gid, z, v) as (
  select gid, z, x from qz
  union select w.gid, w.z, m.b from walk w join ms m on m.gid = w.gid and m.z = w.z and m.a = w.v where m.b <> w.z)
select qz.gid, qz.z, not exists (select 1 from walk w where w.gid = qz.gid and w.z = qz.z and w.v = qz.y) and {clean} as valid from qz"""


ALL_SETS = f"""with recursive {NODES}, {ANC},
q as (select gid, min(v) as x, max(v) as y, count(*) as n from nodes group by gid having count(*) >= 3),
mid as (select n.gid, n.v, row_number() over (partition by n.gid order by n.v) - 1 as k from nodes n join q on q.gid = n.gid where n.v <> q.x and n.v <> q.y),
sub as (select q.gid, q.x, q.y, g.s from q, generate_series(0, 31) as g(s) where g.s < (1 << (q.n - 2))),
sz as (select sub.gid, sub.s, mid.v from sub join mid on mid.gid = sub.gid where (sub.s >> mid.k) & 1 = 1),
f as (select e.gid, e.t, e.h from e join q on q.gid = e.gid where e.t <> q.x),
up(gid, s, v) as (
  select * from (select gid, s, x from sub union select gid, s, y from sub union select gid, s, v from sz)
  union select p.gid, p.s, f.t from up p join f on f.gid = p.gid and f.h = p.v),
m1 as (
  select p.gid, p.s, f.t as a, f.h as b from up p join f on f.gid = p.gid and f.h = p.v
  union select p.gid, p.s, f.t, g.t from up p join f on f.gid = p.gid and f.h = p.v join f g on g.gid = p.gid and g.h = p.v and g.t <> f.t),
ms as (select gid, s, a, b from m1 union select gid, s, b, a from m1),
walk(gid, s, v) as (
  select gid, s, x from sub
  union select w.gid, w.s, m.b from walk w join ms m on m.gid = w.gid and m.s = w.s and m.a = w.v
    where not exists (select 1 from sz where sz.gid = w.gid and sz.s = w.s and sz.v = m.b)),
ok as (
  select sub.gid, sub.s from sub
  where not exists (select 1 from walk w where w.gid = sub.gid and w.s = sub.s and w.v = sub.y)
    and not exists (select 1 from sz join anc a on a.gid = sz.gid and a.d = sz.v where sz.gid = sub.gid and sz.s = sub.s and a.a = sub.x))
select gid, count(*) as n_sets, min(bit_count(s))::bigint as least_size from ok group by gid"""


def _rule_sql(body: str) -> str:
    return f"with {NODES}, {MIXED} select distinct u.gid, u.a, u.b from u {body}"


NOT_ADJACENT = "not exists (select 1 from sk k where k.gid = u.gid and k.a = {0} and k.b = {1})"


def oracle_sql() -> dict[str, str]:
    base = f"with {NODES}"
    closed = f"with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}"
    return {
        "skeleton": f"{base} select gid, t as a, h as b from e",
        "v_structures": f"{base}, {VS} select gid, a, m, b from vs",
        "moral_edges": f"""{base} select gid, t as a, h as b from e
            union select p.gid, p.t, q.t from e p join e q on p.gid = q.gid and p.h = q.h and p.t < q.t""",
        "descendants": f"with recursive {NODES}, {ANC} select gid, a, d from anc",
        "ancestors": f"""with recursive {NODES}, {ANC} select n.gid, n.v,
            (select count(*) from anc where anc.gid = n.gid and anc.d = n.v)::int as n_ancestors,
            (select count(*) from anc where anc.gid = n.gid and anc.a = n.v)::int as n_descendants from nodes n""",
        "acyclicity": f"""with recursive {NODES}, {MIXED},
            t as (select gid, a, b from d union all select gid, b, a from u where a < b),
            r(gid, a, b) as (select gid, a, b from t union select r.gid, r.a, t.b from r join t on t.gid = r.gid and t.a = r.b)
            select g.gid, not exists (select 1 from r where r.gid = g.gid and r.a = r.b) as acyclic from (select distinct gid from nodes) g""",
        "topo_depth": f"""with recursive {NODES}, p(gid, v, n) as (
            select gid, v, 0 from nodes union select p.gid, e.h, p.n + 1 from p join e on e.gid = p.gid and e.t = p.v)
            select gid, v, max(n)::int as depth from p group by gid, v""",
        "undirected_components": f"""with recursive {NODES}, {MIXED},
            r(gid, a, b) as (select gid, a, b from u union select r.gid, r.a, u.b from r join u on u.gid = r.gid and u.a = r.b)
            select gid, a as v, min(b)::int as component from r group by gid, a""",
        "edge_string": f"""{base}, {MIXED},
            parts as (select gid, 0 as k, a, b, a || '->' || b as s from d union all select gid, 1, a, b, a || '-' || b from u where a < b)
            select g.gid, coalesce(string_agg(s, ' ' order by k, a, b), '') as edges
            from (select distinct gid from nodes) g left join parts on parts.gid = g.gid group by g.gid""",
        "shd": f"""{base}, {MIXED} select g.gid, count(u.a)::int as shd
            from (select distinct gid from nodes) g left join u on u.gid = g.gid and u.a < u.b group by g.gid""",
        "cpdag_closure": f"{closed} select gid, a, b, 'd' as kind from cd union all select gid, a, b, 'u' from cu",
        "apply_knowledge": f"""{closed},
            k0 as (select gid, a, b from cd union all select gid, split_part(min(a || ' ' || b), ' ', 1)::int, split_part(min(a || ' ' || b), ' ', 2)::int from cu group by gid),
            {_closed('k0', 's2', 'kd', 'ku')}
            select gid, a, b, 'd' as kind from kd union all select gid, a, b, 'u' from ku""",
        "claim_contradiction": f"""{closed}, al as (select gid, a, b, 'd' as kind from cd union all select gid, a, b, 'u' from cu)
            select gid, case when arg_min(kind, a * 10 + b) = 'd' then 'contradiction' else 'ok' end as status from al group by gid""",
        "all_valid_sets": ALL_SETS,
        "cpdag_summary": f"""{closed},
            g as (select gid, count(*) as n from nodes group by gid)
            select g.n::int as n_nodes, count(*) as n_graphs,
              coalesce(sum((select count(*) from cd where cd.gid = g.gid)), 0)::bigint as n_compelled,
              coalesce(sum((select count(*) from cu where cu.gid = g.gid)), 0)::bigint as n_open from g group by g.n""",
        "meek_r1": _rule_sql("join d on d.gid = u.gid and d.b = u.a where d.a <> u.b and " + NOT_ADJACENT.format("d.a", "u.b")),
        "meek_r2": _rule_sql("join d c on c.gid = u.gid and c.a = u.a join d f on f.gid = u.gid and f.a = c.b and f.b = u.b"),
        "meek_r3": _rule_sql(
            """join u p on p.gid = u.gid and p.a = u.a join u q on q.gid = u.gid and q.a = u.a and p.b < q.b
            join d c on c.gid = u.gid and c.a = p.b and c.b = u.b join d f on f.gid = u.gid and f.a = q.b and f.b = u.b where """
            + NOT_ADJACENT.format("p.b", "q.b")
        ),
        "meek_r4": _rule_sql(
            """join u p on p.gid = u.gid and p.a = u.a and p.b <> u.b
            join d c on c.gid = u.gid and c.a = p.b join d f on f.gid = u.gid and f.a = c.b and f.b = u.b where """
            + NOT_ADJACENT.format("p.b", "u.b")
        ),
        "causal_nodes": _listed("select gid, v from cn"),
        "forbidden_set": _listed("""select gid, v from cn union select cn.gid, a.d from cn join anc a on a.gid = cn.gid and a.a = cn.v
            union select gid, x from q union select gid, y from q"""),
        "optimal_set_dag": _listed("""select distinct cn.gid, e.t as v from cn join e on e.gid = cn.gid and e.h = cn.v join q on q.gid = cn.gid
            where e.t <> q.x and not exists (select 1 from cn c where c.gid = cn.gid and c.v = e.t)"""),
        "d_separation": _separated("select gid, t, h from e", "true"),
        "backdoor_valid": _separated(
            "select e.gid, e.t, e.h from e join q on q.gid = e.gid where e.t <> q.x",
            "not exists (select 1 from anc a where a.gid = qz.gid and a.a = qz.x and a.d = qz.z)",
        ),
        "gac_valid_dag": _separated(
            """select e.gid, e.t, e.h from e join q on q.gid = e.gid where not (e.t = q.x
              and exists (select 1 from cn where cn.gid = e.gid and cn.v = e.h))""",
            """not exists (select 1 from cn where cn.gid = qz.gid and (cn.v = qz.z
              or exists (select 1 from anc a where a.gid = cn.gid and a.a = cn.v and a.d = qz.z)))""",
        ),
    }
