"""Queries about pages, chunks, answers' traces and the explorer's cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text, vectors
from factloom.operators import graph, resolution, sections, verify
from factloom.plans.fixtures import graph as g
from factloom.plans.fixtures import oracle, table
from factloom.plans.register import query

_PAGES = "pg as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as page, unnest(string_split(text, chr(10))) as t from documents), pm as (select doc_id, page, (sum(length(t)) over (partition by doc_id order by page))::bigint as e, length(t) as n from pg)"


def _page_map(spark, d):
    """Lines stand for pages."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return sections.page_map(lines.withColumn("page", (F.col("page") + 1).cast("long")))


@query("s_pagemap", f"with {_PAGES} select doc_id, page, e - n as start, e as \"end\" from pm")
def _(spark, d):
    return _page_map(spark, d)


@query("t_page_of", f"with {_PAGES} select d.doc_id, off, page from (select doc_id, unnest([0, 40, 100000]) as off from documents) d left join pm on d.doc_id = pm.doc_id and off >= e - n and off < e")
def _(spark, d):
    return sections.page_of(table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(40), F.lit(100000))).alias("off")), _page_map(spark, d))


@query("t_chunks")
def _(spark, d):
    return sections.chunks(table(spark, d, "documents"), 60, 6)


@query("t_blend", "with v as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings) select vec_id, (generate_subscripts(e, 1) - 1)::int as i, round(0.7 * unnest(e) / n + 0.3 * unnest(list_concat(e[2:], e[:1])) / n, 6) as b from v")
def _(spark, d):
    """Each vector with itself turned by one place stands for a name and its context."""
    e = F.col("embedding").cast("array<double>")
    turned = F.concat(F.slice(e, 2, 1000), F.slice(e, 1, 1))
    both = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.blend(e, turned)).alias("i", "b"))
    return both.select("vec_id", "i", F.round("b", 6).alias("b"))


@query("a_contradictions", oracle("facts") + "select a, b, sa[:180] as left_text, sb[:180] as right_text from (select uuid as a, statement as sa, lead(uuid) over w as b, lead(statement) over w as sb from facts where status = 'contested' window w as (partition by paper_ref order by uuid)) where b is not null")
def _(spark, d):
    f = g(spark, d, "facts")
    pairs = graph.key_bridges(f.where("status = 'contested'").select("uuid", F.col("paper_ref").alias("entity_key"))).select(F.col("s").alias("a"), F.col("t").alias("b"))
    return graph.disputes(pairs, f)


@query("a_range", oracle("facts") + "select uuid, case when year % 2 = 0 then q_value::int || '–' || (q_value::int + 1) || ' unit' when year % 3 = 0 then '' else q_value::int::string end as range from facts")
def _(spark, d):
    y, v = F.col("year"), F.col("q_value").cast("int")
    low, high = F.when(y % 2 == 0, v), F.when(y % 2 == 0, v + 1)
    return g(spark, d, "facts").select("uuid", graph.value_range(low, high, F.when(y % 3 != 0, v), F.when(y % 2 == 0, F.col("q_unit"))).alias("range"))


@query("a_cluster", r"select doc_id, upper(coalesce(nullif(regexp_extract(n, '^pub_([a-f])\d*$', 1), ''), nullif(regexp_extract(s, 'pub_([a-f])\d*', 1), ''), 'x')) as folder from (select doc_id, case when doc_id % 3 = 0 then 'pub_' || chr((97 + doc_id % 8)::int) || doc_id else 'n' end as n, case when doc_id % 3 = 1 then 'see pub_' || chr((97 + doc_id % 8)::int) || '7' else '' end as s from documents)")
def _(spark, d):
    k = F.col("doc_id")
    letter = F.char(97 + k % 8)
    return table(spark, d, "documents").select("doc_id", text.cluster(F.when(k % 3 == 0, F.concat(F.lit("pub_"), letter, k)).otherwise("n"), F.when(k % 3 == 1, F.concat(F.lit("see pub_"), letter, F.lit("7")))).alias("folder"))


@query("t_hash_embed", "with b as (select p_partkey, [('0x' || sha256(lower(trim(p_name)))[2 * i + 1 : 2 * i + 2])::int / 255.0::double for i in range(32)] as v from part) select p_partkey, unnest(range(64))::int as i, round(unnest(list_concat(v, v)) / sqrt(2 * list_sum([x * x for x in v])), 6) as x from b")
def _(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.posexplode(vectors.hash_embedding(F.col("p_name"))).alias("i", "x"))
    return v.select("p_partkey", "i", F.round("x", 6).alias("x"))


@query("v_apply", oracle("facts") + "select uuid, case when year = 1995 then 'verified' else status end as status, year = 1995 or v_checked as v_checked, case when year = 1995 then 0.7 end::double as v_conf, case when year = 1995 then 'seen' end as v_rationale from facts")
def _(spark, d):
    f = g(spark, d, "facts")
    return verify.apply(f, f.where("year = 1995").select("uuid", F.lit("verified").alias("status"), F.lit(0.7).alias("conf"), F.lit("seen").alias("rationale"))).select("uuid", "status", "v_checked", "v_conf", "v_rationale")


@query("j_nmap", oracle("entities") + "select type as grp, canonical_name as name, min(uuid) as uuid from entities group by 1, 2 union all select type, 'all ' || type, min(uuid) from entities group by 1")
def _(spark, d):
    e = g(spark, d, "entities").select(F.col("type").alias("grp"), "uuid", "canonical_name", F.array("canonical_name", F.concat(F.lit("all "), "type")).alias("aliases"))
    return resolution.names(e)
