"""Queries about background knowledge, and about adjustment on partly directed graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import adjustment as A
from ..operators import criterion as C
from ..operators import graphs as G
from ..operators import knowledge as K
from ..operators import meek as M
from ..operators.fixpoint import settle
from ..sources.population import dags, edge_rows
from .graph_queries import NODES, VD, VS, _closed

Query = Callable[[SparkSession, str], DataFrame]


def open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the CPDAGs of the population leave open, as the DAGs have them (from the lesser to the greater node)."""
    return settle(edge_rows(M.cpdag(dags(spark, sf_dir))).filter("kind = 'u'").select("gid", "a", "b"))


def draw_k_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.draw_true(open_edges(spark, sf_dir), 0.5)


def omit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.omit(open_edges(spark, sf_dir), 0.5)


def flip_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flip(open_edges(spark, sf_dir), 0.5)


def compound_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compound(open_edges(spark, sf_dir), 0.5)


def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tiers(G.depths(dags(spark, sf_dir)), 3, 0.25)


def tiered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tiered(open_edges(spark, sf_dir), tier_assign(spark, sf_dir))


def possible_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, a, d: d is below a in some DAG of a's CPDAG."""
    found = C.with_possible_descendants(M.cpdag(dags(spark, sf_dir)))
    rows = found.select("gid", "labels", F.posexplode("pd").alias("i", "mask"))
    pairs = rows.select("gid", F.get("labels", F.col("i")).alias("a"), F.explode(B.members(F.col("mask"), F.col("labels"))).alias("d"))
    return pairs.filter("a != d")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPDAGs of three nodes or more with x their first and y their last node, z each node between."""
    graphs = M.cpdag(dags(spark, sf_dir).filter(F.size("labels") >= 3)).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})
    return graphs.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels") - 2))).withColumn("z", B.bit(F.col("k")))


def why_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.why_invalid(_asked(spark, sf_dir)).select("gid", F.get("labels", F.col("k")).alias("z"), "reason", "reason_gac")


def _of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.why_invalid(_asked(spark, sf_dir).filter("k = 1"))


def amenability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_pair(spark, sf_dir).select("gid", "amenable")


def _set_query(column: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = F.transform(B.members(F.col(column), F.col("labels")), lambda v: v.cast("string"))
        return _of_pair(spark, sf_dir).select("gid", F.array_join(nodes, ",").alias("nodes"))

    return query


def corrupted_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a claimed graph fares when half of its claims are turned: by the number of claims, graphs, contradictions, and
    graphs whose optimal set (of the true DAG) is still valid."""
    ends = dags(spark, sf_dir).filter(F.size("labels") >= 3)
    found = C.over_graphs(ends, C.chained(K.known_half(1.0), _corrupted), "n_claims long, contradictory boolean, survived boolean")
    # Graphs without an open edge have no claims to turn.
    return found.filter("n_claims > 0").groupBy("n_claims").agg(
        F.count("*").alias("n_graphs"), F.sum(F.col("contradictory").cast("int")).alias("n_contradictory"), F.sum(F.col("survived").cast("int")).alias("n_survived")
    )


def _corrupted(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    """From CPDAGs (fixed, loose) of which all open edges are known (pa): claims, half of them turned as K.flip() does, and what becomes of the
    optimal set of the first and last node."""
    fixed, loose, true = (C._matrix(part.column(c)) for c in ("fixed", "loose", "pa"))
    sizes = part.column("pa").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = np.zeros(len(true), np.int64), sizes - 1
    z = A.optimal_sets(true, x, y)[1]
    claims = K.turned(part, true & ~fixed, 0.5)
    up, open_, wrong = K.contradicted(fixed, loose, claims)
    survived, at = np.zeros(len(true), bool), np.flatnonzero(~wrong)
    survived[at] = ~C.fails(up[at], open_[at], x[at], y[at], z[at])
    many = np.bitwise_count(claims).sum(axis=1, dtype=np.int64) if claims.shape[1] else np.zeros(len(true), np.int64)
    return None, {"n_claims": pa.array(many), "contradictory": pa.array(wrong), "survived": pa.array(survived)}


def queries() -> dict[str, Query]:
    plain = (draw_k_true, omit_claims, flip_claims, compound_claims, tier_assign, tiered_claims, possible_descendants, why_invalid, amenability, corrupted_validity)
    return {f.__name__: f for f in plain} | {"forbidden_set_mpdag": _set_query("forbidden"), "gac_forbidden_mpdag": _set_query("forbidden_gac")}


def _drawn(source: str, tag: str, name: str) -> str:
    return f"""{name} as (
  select gid, a, b, row_number() over (partition by gid order by md5(gid || '|' || a || '|' || b || '|{tag}'), a, b)
    <= round_even(0.5 * count(*) over (partition by gid), 0) as touched from {source})"""


TIERS = """
p(gid, v, n) as (select gid, v, 0 from nodes union select p.gid, e.h, p.n + 1 from p join e on e.gid = p.gid and e.t = p.v),
dp as (select gid, v, max(n) as depth from p group by gid, v),
pl as (
  select gid, v, (row_number() over (partition by gid order by depth, v) - 1) * 3 // count(*) over (partition by gid) as tier,
    row_number() over (partition by gid order by md5(gid || '|' || v || '|t'), v) <= round_even(0.25 * count(*) over (partition by gid), 0) as moved
  from dp),
tr as (
  select gid, v, case when moved then (tier + 1 + ('0x' || substr(md5(gid || '|' || v || '|ts'), 1, 6))::int % 2) % 3 else tier end::int as tier from pl)
"""

BELOW = """
fw as (select gid, a, b from cd union all select gid, a, b from cu union all select gid, b, a from cu),
st(gid, s, u, v) as (
  select gid, a, a, b from fw
  union select st.gid, st.s, st.v, f.b from st join fw f on f.gid = st.gid and f.a = st.v
    where f.b <> st.u and not exists (select 1 from sk k where k.gid = st.gid and k.a = st.u and k.b = f.b)),
pd as (select distinct gid, s as a, v as d from st where s <> v)
"""

ENDS = "q as (select gid, min(v) as x, max(v) as y from nodes group by gid having count(*) >= 3)"


def oracle_sql() -> dict[str, str]:
    closed = f"with recursive {NODES}, {VS}, {VD}, {_closed('vd', 's', 'cd', 'cu')}"
    turned = "select gid, case when touched then b else a end as a, case when touched then a else b end as b from"
    listed = lambda body: f"""{closed}, {BELOW}, {ENDS}, w as ({body})
        select q.gid, string_agg(w.v::varchar, ',' order by w.v) as nodes from q join w on w.gid = q.gid group by q.gid"""  # noqa: E731
    ends = "select gid, x as v from q union select gid, y from q"
    return {
        "draw_k_true": f"{closed}, {_drawn('cu', 'k', 'dr')} select gid, a, b from dr where touched",
        "omit_claims": f"{closed}, {_drawn('cu', 'o', 'dr')} select gid, a, b from dr where not touched",
        "flip_claims": f"{closed}, {_drawn('cu', 'f', 'dr')} {turned} dr",
        "compound_claims": f"{closed}, {_drawn('cu', 'o', 'dr')}, lf as (select gid, a, b from dr where not touched), {_drawn('lf', 'f', 'fl')} {turned} fl",
        "tier_assign": f"with recursive {NODES}, {TIERS} select gid, v, tier from tr",
        "tiered_claims": f"""{closed}, {TIERS}
            select cu.gid, case when s.tier < t.tier then cu.a else cu.b end as a, case when s.tier < t.tier then cu.b else cu.a end as b
            from cu join tr s on s.gid = cu.gid and s.v = cu.a join tr t on t.gid = cu.gid and t.v = cu.b where s.tier <> t.tier""",
        "possible_descendants": f"{closed}, {BELOW} select gid, a, d from pd",
        "forbidden_set_mpdag": listed(f"{ends} union select q.gid, pd.d from q join pd on pd.gid = q.gid and pd.a = q.x"),
        "gac_forbidden_mpdag": listed(f"""{ends} union select q.gid, c.b from q join cd c on c.gid = q.gid and c.a = q.x
              where c.b = q.y or exists (select 1 from pd where pd.gid = q.gid and pd.a = c.b and pd.d = q.y)
            union select q.gid, pd.d from q join cd c on c.gid = q.gid and c.a = q.x join pd on pd.gid = q.gid and pd.a = c.b
              where c.b = q.y or exists (select 1 from pd o where o.gid = q.gid and o.a = c.b and o.d = q.y)"""),
    }
