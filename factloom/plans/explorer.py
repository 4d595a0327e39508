"""Queries of the explorer over its graph of nodes and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import analytics, graph
from factloom.plans.fixtures import graph as g
from factloom.plans.fixtures import oracle
from factloom.plans.register import query

_LINKS = "links as (select src as node, dst as other, type from xedges union all select dst, src, type from xedges)"


def _nodes(spark, d):
    return g(spark, d, "xnodes")


def _links(spark, d):
    return graph.adjacency(g(spark, d, "xedges"))


@query("a_filter", oracle("xnodes") + "select node, kind in ('Material', 'Process', 'Finding') and (geography is null or geography in ('', 'RU', 'RU+world')) as visible from xnodes")
def _(spark, d):
    return analytics.visible(_nodes(spark, d), ["Material", "Process", "Finding"], "RU").select("node", "visible")


@query("a_edge_filter", oracle("xedges") + "select src, dst, type, type in ('DESCRIBED_IN', 'CONTRADICTS') as visible from xedges")
def _(spark, d):
    return analytics.visible_links(g(spark, d, "xedges"), ["DESCRIBED_IN", "CONTRADICTS"])


@query("a_search", oracle("xnodes") + "select node from xnodes where contains(lower(label), 'ring') or contains(lower(coalesce(name, statement, '')), 'ring') union all select node from xnodes where contains(lower(label), 'took 7 of') or contains(lower(coalesce(name, statement, '')), 'took 7 of')")
def _(spark, d):
    return analytics.search(_nodes(spark, d), " RING ").select("node").union(analytics.search(_nodes(spark, d), "took 7 of").select("node")).union(analytics.search(_nodes(spark, d), "  ").select("node"))


@query("a_by_relation", oracle("xedges") + f", {_LINKS}, o as (select distinct node, type, other from links), r as (select *, row_number() over (partition by node, type order by other) as r from o) select node, type, count(*) as n, string_agg(other, ',' order by other) filter (where r <= 5) as others from r group by 1, 2")
def _(spark, d):
    return analytics.neighbours_by_relation(_links(spark, d)).select("node", "type", "n", F.array_join("others", ",").alias("others"))


@query("a_summary", oracle("xnodes", "xedges") + f", {_LINKS} select n.node, count(l.node) as links, count(distinct other) filter (where l.type in ('DESCRIBED_IN', 'VALIDATED_BY')) as sources, count(*) filter (where l.type in ('DESCRIBED_IN', 'VALIDATED_BY')) = 0 as no_source, count(*) filter (where l.type = 'OPERATES_AT_CONDITION') = 0 and kind not in ('Condition', 'Publication', 'Expert', 'Facility') as no_conditions, count(l.node) <= 1 as lonely, count(*) filter (where l.type = 'CONTRADICTS') > 0 as disputed from xnodes n left join links l on n.node = l.node group by n.node, kind")
def _(spark, d):
    return analytics.summary(_nodes(spark, d), _links(spark, d))


@query("a_gaps", oracle("xnodes", "xedges") + f", {_LINKS} select n.node, 'sparse' as reason, count(l.node) as degree, count(*) filter (where o.kind = 'Process') as processes, count(*) filter (where o.kind = 'Condition') as conditions from xnodes n left join links l on n.node = l.node left join xnodes o on l.other = o.node where n.kind = 'Material' group by n.node having count(l.node) <= 1 union all select node, 'said', null, null, null from xnodes where kind = 'Finding' and is_gap")
def _(spark, d):
    return analytics.gaps(_nodes(spark, d), _links(spark, d))


@query("a_geo", oracle("xnodes") + "select coalesce(geography, '') as geography, count(*) as n from xnodes group by 1")
def _(spark, d):
    return analytics.geography(_nodes(spark, d))[0]


@query("a_geo_folders", oracle("xnodes") + r", f as (select upper(coalesce(nullif(regexp_extract(node, '^pub_([a-f])\d*$', 1), ''), nullif(regexp_extract(coalesce(source, ''), 'pub_([a-f])\d*', 1), ''), 'x')) as folder, geography from xnodes) select folder, count(*) as members, count(*) filter (where geography in ('RU', 'RU+world')) as ru, count(*) filter (where geography in ('world', 'RU+world')) as world, count(*) filter (where geography in ('RU', 'RU+world')) = 0 as zero_ru from f where folder <> 'X' group by 1")
def _(spark, d):
    return analytics.geography(_nodes(spark, d))[1]


@query("a_geo_pure", oracle("xnodes") + "select count(*) filter (where geography = 'RU') as pure_ru, count(*) as total from xnodes where kind in ('Material', 'Process')")
def _(spark, d):
    return analytics.geography(_nodes(spark, d))[2]


@query("a_experts", oracle("xnodes", "xedges") + f", {_LINKS}, t as (select n.node as expert, count(*) filter (where type = 'AUTHORED_BY') as authored, count(*) filter (where type = 'WORKS_AT') as works_at from xnodes n left join links l on n.node = l.node where kind = 'Expert' group by 1), s as (select *, authored + works_at as total, floor(authored * 100.0::double / (select count(*) from xedges where type = 'AUTHORED_BY') + 0.5)::bigint as share from t) select *, share >= 50 as risk, total = 0 as orphan from s")
def _(spark, d):
    return analytics.experts(_nodes(spark, d), g(spark, d, "xedges"))


@query("a_heatmap", oracle("xnodes", "xedges") + f", {_LINKS}, m as (select node as material from xnodes where kind = 'Material' order by node limit 20), c as (select node as condition from xnodes where kind = 'Condition' order by node limit 18), nm as materialized (select distinct node, other from links where node in (select material from m)), nc as materialized (select distinct node, other from links where node in (select condition from c)), sh as (select distinct nm.node as material, nc.node as condition from nm join nc using (other)) select material, condition, case when dm.node is not null then 3 when sh.material is not null then 2 else 0 end as level from m cross join c left join nm dm on dm.node = material and dm.other = condition left join sh using (material, condition)")
def _(spark, d):
    return analytics.heatmap(_nodes(spark, d), _links(spark, d))


_DEGREE = "dg as (select node, count(*) as degree from links group by node)"


@query("a_research", oracle("xnodes", "xedges") + f", {_LINKS}, {_DEGREE} select n.node, coalesce(degree, 0) as degree from xnodes n left join dg using (node) where (n.node = 'p:ECONOMY' or n.node in (select other from links where node = 'p:ECONOMY')) and (n.node = 'c:1-URGENT' or n.node in (select other from links where node = 'c:1-URGENT')) and (geography is null or geography in ('', 'RU', 'RU+world')) and coalesce(low, value) is not null and coalesce(high, value) >= 10 and coalesce(low, value) <= 30 order by degree desc, n.node limit 60")
def _(spark, d):
    return analytics.research(_nodes(spark, d), _links(spark, d), ["p:ECONOMY", "c:1-URGENT"], "RU", 10, 30)


@query("a_ranges", oracle("xnodes", "xedges") + f", {_LINKS}, {_DEGREE} select n.node, coalesce(degree, 0) as degree from xnodes n left join dg using (node) where coalesce(low, value) is not null and coalesce(high, value) >= 48 order by degree desc, n.node limit 60")
def _(spark, d):
    """Ranges that reach from a value on, of any node."""
    return analytics.research(_nodes(spark, d), _links(spark, d), [], None, 48)


_HITS = "hits as (select node, row_number() over (order by node) - 1 as pos from xnodes where contains(lower(label), 'r') and kind <> 'Finding')"


def _hits(spark, d):
    """Nodes whose name holds a letter, in the order of ids, which here are as many as the table has."""
    n = _nodes(spark, d).where("kind <> 'Finding' and contains(lower(label), 'r')").select("node")
    return n.withColumn("pos", F.row_number().over(Window.orderBy("node")) - 1)


@query("a_grouped_hits", oracle("xnodes") + f", {_HITS} select kind, node from (select kind, node, row_number() over (partition by kind order by pos) as r from hits join xnodes using (node)) where r <= 5")
def _(spark, d):
    return analytics.grouped(_hits(spark, d), _nodes(spark, d))[0]


@query("a_context", oracle("xnodes") + f", {_HITS} select node, coalesce(nullif(name, ''), nullif(statement, ''), node) as name, kind, coalesce(statement, '')[:220] as definition, case when low is not null and high is not null then low || '–' || high else coalesce(value::varchar, '') end as range, geography, source, pos::int as pos from hits join xnodes using (node) where pos < 14")
def _(spark, d):
    return analytics.grouped(_hits(spark, d), _nodes(spark, d))[1]


@query("a_sources", oracle("xnodes") + ", s as (select node, case when kind = 'Material' then source || ', ' || 'f1' || ',  a paper ,' when kind = 'Facility' then null else source end as source from xnodes), p as (select node, n, trim(part) as part from (select node, generate_subscripts(string_split(source, ','), 1) as n, unnest(string_split(source, ',')) as part from s where source <> '')), q as (select p.node, n, case when k.node is null then part else coalesce(k.name, k.node) || case when k.kind = 'Facility' then ' (' || k.label || ')' else '' end end as said from p left join xnodes k on k.node = p.part) select s.node, coalesce(string_agg(said, '; ' order by n), '') as source from s left join q on s.node = q.node group by 1")
def _(spark, d):
    n = _nodes(spark, d)
    source = F.when(F.col("kind") == "Material", F.concat("source", F.lit(", f1,  a paper ,"))).when(F.col("kind") != "Facility", F.col("source"))
    return graph.resolve_sources(n.select("node", source.alias("source")), n.select("node", "name", F.when(F.col("kind") == "Facility", F.col("label")).alias("code")))


@query("a_neighbors", oracle("xedges") + ", e as (select *, md5(src || '|' || dst || '|' || type) as eid from xedges), l as (select src as node, dst as other, type, eid from e union all select dst, src, type, eid from e), o as (select node, other, min(eid) as first, arg_max(type, eid) as type from l group by 1, 2) select node, other, type from (select *, row_number() over (partition by node order by first, other) as r from o) where r <= 30")
def _(spark, d):
    out = F.col("dir") == "out"
    ends = F.when(out, F.col("node")).otherwise(F.col("other")), F.when(out, F.col("other")).otherwise(F.col("node"))
    return graph.neighbors(_links(spark, d), eid=F.md5(F.concat_ws("|", *ends, "type")))
