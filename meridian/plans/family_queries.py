"""Queries over families of random DAGs, one graph for each order, and about paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import families as R
from ..operators import meek as M
from ..operators import paths as P
from ..sources import families as S
from ..sources.population import dags, edge_rows, table
from .criterion_queries import BELOW, ENDS, _asked
from .graph_queries import NODES, VD, VS, _closed

Query = Callable[[SparkSession, str], DataFrame]


def _between(tag: str, least: int, most: Column | int) -> Column:
    """A number from ``least`` to ``most`` for each graph."""
    return (F.lit(least) + S.drawn(F.col("gid"), F.lit(tag)) % (F.lit(most) - (least - 1))).cast("int")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gid"))


def block_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _orders(spark, sf_dir).withColumn("n", _between("n", 4, 12))
    return edge_rows(S.block(sized, 3, 60, 10)).drop("kind")


def scale_free_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _orders(spark, sf_dir).withColumn("n", _between("n", 4, 12))
    return edge_rows(S.scale_free(sized, 2)).drop("kind")


def decoupled_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _orders(spark, sf_dir).withColumns({"n": _between("n", 7, 12), "coupling": _between("c", 0, 4) / F.lit(4.0)})
    return edge_rows(S.decoupled(sized)).drop("kind")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _orders(spark, sf_dir).withColumn("size", _between("n", 3, 8))
    return S.component(sized.withColumn("separation", _between("s", 1, F.col("size") - 1)), 30)


def component_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(_components(spark, sf_dir)).drop("kind")


def component_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graphs of the component family turn out to be, measured on their CPDAGs."""
    return R.realised(_components(spark, sf_dir)).select("gid", "component_size", "component_edges", "separation", "settled")


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPDAGs of three nodes or more with x their first and y their last node."""
    return M.cpdag(dags(spark, sf_dir).filter(F.size("labels") >= 3)).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})


def _told(found: DataFrame, *more: Column) -> DataFrame:
    names = F.transform("path", lambda v: F.get("labels", v).cast("string"))
    return found.select("gid", *more, F.array_join(names, ">").alias("path"))


def possibly_causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(P.possibly_causal_paths(_ends(spark, sf_dir)))


def definite_non_causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(P.definite_non_causal_paths(_ends(spark, sf_dir)))


def open_path_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node between x and y as z the path that shows z not to block."""
    return _told(P.open_path_witness(_asked(spark, sf_dir), ["gid", "k"]), F.get("labels", F.col("k")).alias("z"))


def causal_nodes_mpdag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.causal_nodes(_ends(spark, sf_dir))
    listed = lambda m: F.array_join(F.transform(B.members(F.col(m), F.col("labels")), lambda v: v.cast("string")), ",")
    return found.select("gid", listed("cn").alias("causal"), listed("forbidden").alias("forbidden"))


def queries() -> dict[str, Query]:
    families = (block_graphs, scale_free_graphs, decoupled_graphs, component_graphs, component_realised)
    ways = (possibly_causal_paths, definite_non_causal_paths, open_path_witness, causal_nodes_mpdag)
    return {f.__name__: f for f in (*families, *ways)}


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5({' || '.join(p if i == 0 else f'''chr(124) || {p}''' for i, p in enumerate(parts))}), 1, 6))::int"


def _percent(*parts: str) -> str:
    return f"{_hash(*parts).replace('1, 6', '1, 4')} % 100"


def _orders_sql(least: int, most: int) -> str:
    return f"fam as (select o_orderkey as gid, {least} + {_hash('o_orderkey', chr(39) + 'n' + chr(39))} % {most - least + 1} as n from orders)"


KEYED = f"kd as (select gid, n, v, {_hash('gid', 'v', chr(39) + 'o' + chr(39))} as k from (select gid, n, unnest(range(n))::int as v from fam))"
#: Edges li (gid, a, b with a < b) directed along the drawn order.
DIRECTED = """
select li.gid, (case when (p.k, p.v) < (q.k, q.v) then li.a else li.b end)::int as a, (case when (p.k, p.v) < (q.k, q.v) then li.b else li.a end)::int as b
from li join kd p on p.gid = li.gid and p.v = li.a join kd q on q.gid = li.gid and q.v = li.b"""

GROWN = f"""
co as (select gid, n as size, 1 + {_hash('gid', "'s'")} % (n - 1) as separation from fam),
gr(gid, size, separation, j, ed) as (
  select gid, size, separation, separation + 1, list_transform(range(separation), lambda i: [i::int, i::int + 1]) from co
  union all
  select gid, size, separation, j + 1,
    list_concat(ed, case when tri then [[base, j::int], [near[1 + {_hash('gid', 'j', "'n'")} % len(near)], j::int]] else [[base, j::int]] end)
  from (
    select *, list_sort(list_transform(list_filter(ed, lambda e: e[1] = base or e[2] = base), lambda e: e[1] + e[2] - base)) as near
    from (
      select *, ({_hash('gid', 'j', "'a'")} % j)::int as base, {_percent('gid', 'j', "'t'")} < 30 as tri from gr where j < size)))
"""


def oracle_sql() -> dict[str, str]:
    closed = f"with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}, {BELOW}, {ENDS}"
    edges = """ad as (select gid, a, b, 'o' as k from cd union all select gid, b, a, 'i' from cd
        union all select gid, a, b, 'u' from cu union all select gid, b, a, 'u' from cu)"""
    surely_none = """(p.k = 'i' or n.k = 'o' or (p.k = 'u' and n.k = 'u'
        and not exists (select 1 from sk where sk.gid = p.gid and sk.a = p.path[-2] and sk.b = n.b)))"""
    causal = """pc(gid, y, path) as (
        select gid, y, [x] from q
        union all select p.gid, p.y, list_append(p.path, f.b) from pc p join fw f on f.gid = p.gid and f.a = p.path[-1]
          where p.path[-1] <> p.y and not list_contains(p.path, f.b))"""
    named = "array_to_string(path, '>') as path"
    return {
        "block_graphs": f"""with {_orders_sql(4, 12)}, {KEYED}, li as (
            select gid, a, b from (select gid, a, unnest(range(a + 1, n))::int as b from (select gid, n, unnest(range(n))::int as a from fam))
            where {_percent('gid', 'a', 'b', "'b'")} < case when a % 3 = b % 3 then 60 else 10 end) {DIRECTED}""",
        "scale_free_graphs": f"""with recursive {_orders_sql(4, 12)}, {KEYED}, sf(gid, n, j, ends) as (
            select gid, n, 3, [0, 2, 1, 2] from fam
            union all
            select gid, n, j + 1, list_concat(ends, [least(f, g), j, greatest(f, g), j]) from (
              select *, pool[1 + {_hash('gid', 'j', "'1'", "'s'")} % len(pool)] as g from (
                select *, list_filter(ends, lambda v: v <> f) as pool from (
                  select *, ends[1 + {_hash('gid', 'j', "'0'", "'s'")} % len(ends)] as f from sf where j < n)))),
            li as (select gid, ends[k] as a, ends[k + 1] as b from (select gid, ends, unnest(range(1, len(ends), 2)) as k from sf where j = n)) {DIRECTED}""",
        "decoupled_graphs": f"""with {_orders_sql(7, 12)},
            c as (select gid, n, (n - 2) // 2 as g, (n - 3) // 2 as h, {_hash('gid', "'c'")} % 5 / 4.0 as coupling from fam),
            l as (select *, 2 + g as one, n - 1 as two from c),
            e as (
              select gid, unnest([one, one, two, two, 0, 2]) as a, unnest([0, 1, 0, 1, 1, 1]) as b from l
              union all select gid, v - 1, v from (select gid, unnest(range(4, one + 1)) as v from l)
              union all select gid, v - 1, v from (select gid, unnest(range(one + 2, n)) as v from l)
              union all select gid, one - 1, v from (select gid, one, unnest(range(n - round_even(coupling * h, 0)::int, n)) as v from l))
            select gid, a::int as a, b::int as b from e""",
        "component_graphs": f"""with recursive {_orders_sql(3, 8)}, {GROWN}
            select gid, e[1]::int as a, e[2]::int as b from (select gid, unnest(ed) as e from gr where j = size)
            union all select gid, unnest([0, separation, size + 1])::int, size::int from co""",
        "component_realised": f"""with recursive {_orders_sql(3, 8)}, {GROWN}
            select gid, size::int as component_size, len(ed)::int as component_edges, separation::int as separation, true as settled from gr where j = size""",
        "possibly_causal_paths": f"{closed}, {causal} select gid, {named} from pc where path[-1] = y",
        "definite_non_causal_paths": f"""{closed}, {edges}, dn(gid, y, path, k, back) as (
            select gid, y, [x], '', false from q
            union all select p.gid, p.y, list_append(p.path, n.b), n.k, p.back or n.k = 'i' from dn p join ad n on n.gid = p.gid and n.a = p.path[-1]
              where p.path[-1] <> p.y and not list_contains(p.path, n.b) and (p.k = '' or (p.k = 'o' and n.k = 'i') or {surely_none}))
            select gid, {named} from dn where path[-1] = y and back""",
        "open_path_witness": f"""{closed}, {edges}, qz as (select q.*, nodes.v as z from q join nodes on nodes.gid = q.gid and nodes.v not in (q.x, q.y)),
            op(gid, y, z, path, k, back) as (
              select gid, y, z, [x], '', false from qz
              union all select p.gid, p.y, p.z, list_append(p.path, n.b), n.k, p.back or n.k = 'i' from op p join ad n on n.gid = p.gid and n.a = p.path[-1]
                where p.path[-1] <> p.y and not list_contains(p.path, n.b) and (p.k = '' or (p.path[-1] <> p.z and {surely_none})
                  or (p.k = 'o' and n.k = 'i' and (p.path[-1] = p.z or exists (select 1 from pd where pd.gid = p.gid and pd.a = p.path[-1] and pd.d = p.z))))),
            r as (select *, row_number() over (partition by gid, z order by len(path), path) as i from op where path[-1] = y and back)
            select gid, z, {named} from r where i = 1""",
        "causal_nodes_mpdag": f"""{closed}, {causal}, cn as (select distinct gid, unnest(path[2:]) as v from pc where path[-1] = y),
            fo as (select gid, x as v from q union select gid, v from cn union select cn.gid, pd.d from cn join pd on pd.gid = cn.gid and pd.a = cn.v),
            c as (select gid, string_agg(v::varchar, ',' order by v) as causal from cn group by gid),
            f as (select gid, string_agg(v::varchar, ',' order by v) as forbidden from fo group by gid)
            select gid, coalesce(causal, '') as causal, forbidden from f left join c using (gid)""",
    }
