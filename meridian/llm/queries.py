"""Queries of this subpackage, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, which the tokenizers' package tells."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_outliers import judge

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_suffix_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_count", "lines_deleted", "text")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .poisson_mix import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "mix_copies", "mix_copy")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, format_chats

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_chats(rows.unionByName(more)))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import train_and_score

    docs = table(spark, sf_dir, "documents")
    return train_and_score(docs)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney_langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ring_shard import bounded_ring

    placed = bounded_ring(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_pack import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, failure_counts, text_failures

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(failure_counts(docs, labels, [*text_failures(F.col("text")).values()]), "ABCDE")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restore

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rebuilt = restore(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(rebuilt).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_line_dedup, op3_document_fingerprints, op4_ngram_jaccard_join, op5_source_mixing, op6_chat_formatting, op7_lm_scoring, op8_language_id, op9_sharding,
        op10_best_fit_packing, op11_nearest_neighbours, op12_filter_audit, op13_fill_in_middle,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mixing": OP5_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }


def _escaped(column: str) -> str:
    """The SQL of chat_format.escape: the control strings, in its order."""
    from .chat_format import BODY, CLOSE, ESCAPES, FOREIGN, NEXT, OPEN

    out = f"replace({column}, '%', '%25')"
    for control in (OPEN, BODY, NEXT, CLOSE, *FOREIGN):
        out = f"replace({out}, '{control}', '{ESCAPES[control[0]] + control[1:]}')"
    return out


OP6_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_escaped('text')}) + case when before is distinct from role then length({_escaped('role')}) + 23 else 8 end)::bigint as formatted_chars
from t group by conv_id
"""


OP5_SQL = """
with sizes as (select source, sum(coalesce(length(text), 0) + 1) as size from documents group by source),
rates as (
  select source, sqrt(size::double) * (select sum(size) from sizes)
    / ((select sum(sqrt(size::double)) from sizes) * size) as rate
  from sizes),
terms as (
  select source, rate, k, case when k = 0 then exp(-rate) else exp(k * ln(rate) - rate - lgamma(k + 1)) end as p
  from rates, generate_series(0, 60) as g(k)),
cdf as (select source, k, sum(p) over (partition by source order by k) as c from terms),
drawn as (
  select doc_id, source, text,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(source, ''), '5')), 1, 13))::bigint / 4503599627370496.0 as u
  from documents),
counted as (
  select d.doc_id, d.source, d.text, count(c.k) as mix_copies
  from drawn d join cdf c on d.source is not distinct from c.source and c.c <= d.u
  group by all)
select doc_id, source, text, mix_copies::int as mix_copies, unnest(generate_series(0, mix_copies - 1))::int as mix_copy
from counted
"""


OP12_SQL = r"""
with l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
t as (
  select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as text, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents d left join l on l.doc_id = d.doc_id),
m as (
  select part, good, toxic,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by text))::int as fails
  from t),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, fails),
f as (select unnest(range(5)) as f, unnest(['A', 'B', 'C', 'D', 'E']) as letter),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (
  select o.filter_order, g.step, substr(o.filter_order, g.step, 1) as letter,
    1 << (ascii(substr(o.filter_order, g.step, 1)) - 65) as own,
    list_sum(list_transform(range(1, g.step), lambda i: 1 << (ascii(substr(o.filter_order, i, 1)) - 65)))::bigint as earlier
  from o, generate_series(1, 5) as g(step)),
r as (
  select c.part, s.filter_order, s.step, s.letter,
    sum(case when fails & (own | coalesce(earlier, 0)) = 0 then n else 0 end)::bigint as kept,
    sum(case when fails & own <> 0 and fails & coalesce(earlier, 0) = 0 then n else 0 end)::bigint as removed,
    sum(case when fails & own <> 0 and fails & coalesce(earlier, 0) <> 0 then n else 0 end)::bigint as redundant,
    sum(case when fails = own then n else 0 end)::bigint as unique_fails,
    sum(case when fails & own <> 0 and fails & coalesce(earlier, 0) = 0 then good else 0 end)::bigint as good_lost,
    sum(case when fails & own <> 0 and fails & coalesce(earlier, 0) = 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by all)
select part, filter_order, step::int as step, letter as filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, letter)::bigint as shapley
from r
"""


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
    sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, len(u) as n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] as hs from t),
c as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b from d),
p as (
  select doc_id, n, text, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 100 then 'plain'
      when hs[4] % 100 < 50 then 'spm' else 'psm' end as form
  from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
