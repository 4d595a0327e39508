"""All queries of the fact-graph engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import text, vectors
from factloom.operators import dedup, graph, papers, resolution, retrieval, sections, verify
from factloom.plans.fixtures import HEAD as _HEAD
from factloom.plans.fixtures import graph as g
from factloom.plans.fixtures import oracle, table
from factloom.plans.register import ORACLES, QUERIES, Query, query
from factloom.sources import control, store

NP = ", ".join(f"'{t}'" for t in vocab.NON_PARTICIPANT)
MEMBERS = f"members as (select distinct e.src as fact, n.uuid as entity, n.type as type, n.canonical_name as name from edges e join entities n on e.dst = n.uuid where e.type not in ({NP}))"
ASK = [("ring", "Material"), ("NATION_16", "Location"), ("economy", None)]
ASK_SQL = "asked(mention, kind) as (values ('ring', 'Material'), ('NATION_16', 'Location'), ('economy', null))"
LINKED = "anchors as (select distinct a.mention, n.uuid as entity from asked a join entities n on (a.kind is null or a.kind = n.type) and (lower(n.canonical_name) = lower(a.mention) or (length(a.mention) >= 3 and (contains(lower(n.canonical_name), lower(a.mention)) or contains(lower(a.mention), lower(n.canonical_name))))))"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def members(spark, d):
    return graph.participants(g(spark, d, "edges"), g(spark, d, "entities"), keyed=True)


def asked(spark):
    return spark.createDataFrame(ASK, "mention string, type string")


# analytics


@query("a_stats_entities", oracle("entities") + "select type, count(*) as n from entities group by type")
def _(spark, d):
    return g(spark, d, "entities").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("a_stats_frames", oracle("facts") + "select frame_type, count(*) as n, count(*) filter (where status = 'contested') as contested from facts group by frame_type")
def _(spark, d):
    return g(spark, d, "facts").groupBy("frame_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "contested").alias("contested"))


@query("a_stats_sources", oracle("facts") + "select paper_ref, count(*) as n from facts group by paper_ref order by n desc, paper_ref limit 25")
def _(spark, d):
    return g(spark, d, "facts").groupBy("paper_ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "paper_ref").limit(25)


@query("a_stats_totals", oracle("facts") + "select count(*) as facts, count(distinct paper_ref) as papers, min(year) as first_year, max(year) as last_year from facts")
def _(spark, d):
    return g(spark, d, "facts").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("paper_ref").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("a_stats_top_entities", oracle("entities", "edges") + f", {MEMBERS} select name, type, count(*) as n from members group by name, type order by n desc, name, type limit 15")
def _(spark, d):
    return members(spark, d).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name", "type").limit(15)


@query("a_legend", oracle("edges") + "select type, count(*) as n from edges group by type")
def _(spark, d):
    return g(spark, d, "edges").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("a_trace_cost", "select event_type, count(*) as calls, round(sum(value), 4) as cost, sum(cast(json_extract(props, '$.k') as bigint))::bigint as tokens from events group by event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


# texts


@query("t_tokens", "select doc_id, greatest(1, length(text) // 4) as tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


@query("t_lang", r"select doc_id, case when length(regexp_replace(text[:4000], '[^\x{0400}-\x{04FF}]', '', 'g')) > length(regexp_replace(lower(text[:4000]), '[^a-z]', '', 'g')) then 'ru' when regexp_matches(lower(text[:4000]), '[a-z]') then 'en' end as lang from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.detect_lang(F.col("text")).alias("lang"))


@query("t_hash", "select doc_id, sha1(text) as hash from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("hash"))


@query("t_slice", "select doc_id, substring(text, 11, 30) as span, case when length(text) is null then '' else trim(substring(text[:least(length(text), 360)], 1, 600)) end as snippet from documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.slice_span(t, F.lit(10), F.lit(40)).alias("span"), text.snippet(t, F.lit(160), F.lit(200)).alias("snippet"))


@query("t_lines", "select doc_id, n - 1 as n, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as off from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)")
def _(spark, d):
    # a document's lines stay in one row until their offsets are known: no shuffle
    parts = F.split("text", "\n")
    step = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("offs")), lambda a, x: F.struct((a["at"] + F.char_length(x) + 1).alias("at"), F.concat(a["offs"], F.array(a["at"])).alias("offs")), lambda a: a["offs"])
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), step.alias("off"))).alias("n", "x")).select("doc_id", F.col("n").cast("long").alias("n"), "x.line", "x.off")


@query("t_is_heading", rf"with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as s from documents) select doc_id, n, s as heading from l where {_HEAD}")
def _(spark, d):
    return lines(spark, d).where(text.is_heading(F.col("line"))).select("doc_id", F.col("n").cast("long").alias("n"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("heading"))


@query("t_sections", rf'''with l as (select doc_id, length(text) as size, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents), o as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::int as off, regexp_replace(line, '^\s+|\s+$', '', 'g') as s from l), h as (select doc_id, size, off, s, lead(off) over (partition by doc_id order by off) as nxt, min(off) over (partition by doc_id) as fst from o where {_HEAD}) select doc_id, off as start, coalesce(nxt, size)::int as "end", s as name from h union all select distinct doc_id, 0, fst, 'frontmatter' from h where fst > 0 union all select doc_id, 0, length(text)::int, 'body' from documents where length(text) > 0 and doc_id not in (select doc_id from h)''')
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(sections.sections(F.col("text"))).alias("s"))
    return docs.select("doc_id", "s.start", "s.end", "s.name")


_CASES = ["I.\nINTRODUCTION", "2.2 Methodology", "A. Results and discussion", "References", "Data availability statement", "Pareto Fronts", "IV) Conclusions:", "mild steel", "  3.1   Experimental   setup "]


@query("t_role_hint", "with c(i, name) as (values " + ", ".join(f"('c{i}', '{c}')" for i, c in enumerate(_CASES)) + r" union all select doc_id || '-' || n, line from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents)), p(ord, k, role) as (values " + ", ".join(f"({i}, '{k}', '{r}')" for i, (k, r) in enumerate(vocab.SECTION_PRIORS)) + r"), n as (select i, rtrim(lower(trim(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '(?i)^(?:[ivxlcdm]+|\d+(?:\.\d+)*|[a-z])[.)]?\s+', ''))), ':') as norm from c), e as (select i, norm, role from n join p on k = norm), w as (select i, arg_min(role, ord) as role from n join p on regexp_matches(norm, '\b' || k || '\b') group by i) select n.i, n.norm, coalesce(e.role, w.role) as role from n left join e on n.i = e.i left join w on n.i = w.i")
def _(spark, d):
    """Headings by hand and every line of the documents."""
    own = lines(spark, d).select(F.concat("doc_id", F.lit("-"), "n").alias("i"), F.col("line").alias("name"))
    hand = spark.createDataFrame([(f"c{i}", c) for i, c in enumerate(_CASES)], "i string, name string")
    return hand.union(own).select("i", text.norm_heading(F.col("name")).alias("norm"), text.role_hint(F.col("name")).alias("role"))


@query("t_key", oracle("entities") + r"select uuid, type || ':' || substring(regexp_replace(lower(trim(canonical_name)), '\s+', '-', 'g'), 1, 80) as entity_key from entities")
def _(spark, d):
    return g(spark, d, "entities").select("uuid", text.key(F.col("type"), F.col("canonical_name")).alias("entity_key"))


@query("t_qstr", oracle("facts") + "select uuid, case when year = 1995 then q_raw else trim(q_operator || cast((q_value * year / 700)::double as varchar) || ' ' || q_unit) end as q from facts union all select 'p' || p_partkey, trim('~' || cast(p_retailprice / 8 as varchar)) from part union all select 'n', ''")
def _(spark, d):
    """Whole numbers, decimals, quantities as written, without a unit, and none at all."""
    none, y = F.lit(None).cast("string"), F.col("year")
    f = g(spark, d, "facts").select("uuid", text.quantity(F.when(y == 1995, F.col("q_raw")), F.col("q_operator"), F.col("q_value") * y / 700, F.col("q_unit")).alias("q"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey"), text.quantity(none, F.lit("~"), F.col("p_retailprice") / 8, none))
    return f.union(p).union(spark.range(1).select(F.lit("n"), text.quantity(none, F.lit("="), F.lit(None).cast("double"), F.lit("eV"))))


_NAMES = ["Ni-15Cr alloy", "", "RF power 500 W at 50 sccm", "grown at 300 nm", "a b c d e f g h i", None, "анод 20 °C и 5 мм"]


@query("t_conceptual", r"with n(i, name) as (values " + ", ".join(f"('{i}', {'null' if n is None else repr(n)})" for i, n in enumerate(_NAMES)) + r" union all select doc_id || '-' || n, line from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents)) select i, name is not null and trim(name) <> '' and len(string_split(trim(regexp_replace(name, '\s+', ' ', 'g')), ' ')) <= 8 and len(regexp_extract_all(name, '(?i)\d+(?:\.\d+)?\s*(?:W|kW|V|mV|A|mA|sccm|nm|µm|um|mm|cm|Å|K|°C|℃|µbar|ubar|bar|Pa|kPa|MPa|GPa|Torr|rpm|Hz|kHz|MHz|GHz|min|mins|hr|h|ms|eV|meV|wt%|at%|%)(?:\b|$)')) < 2 as ok from n")
def _(spark, d):
    """Names by hand and every line of the documents."""
    own = lines(spark, d).select(F.concat("doc_id", F.lit("-"), "n").alias("i"), F.col("line").alias("name"))
    hand = spark.createDataFrame([(str(i), n) for i, n in enumerate(_NAMES)], "i string, name string")
    return hand.union(own).select("i", text.conceptual(F.col("name")).alias("ok"))


@query("t_ent_text", "select p_partkey, array_to_string(list_distinct_ordered, ' ; ') as t from (select p_partkey, case when p_name = p_brand then [p_name] else [p_name, p_brand] end as list_distinct_ordered from part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.entity_text(F.col("p_name"), F.array("p_brand", F.lit(""), "p_name")).alias("t"))


@query("t_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, (select embedding from embeddings where vec_id = 0) b")
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


# sources and store


_REFS = ["arxiv:2401.01234v2", "2401.0123", " 2401.01234 ", "https://arxiv.org/abs/2401.01234", "http://ARXIV.org/pdf/2401.01234v3.pdf", "https://arxiv.org/abs/hep-th/9901001", "a/b/C.PDF", " x.pdf", "x.docx", "12401.01234"]


@query("s_route", r"with r(i, ref) as (values " + ", ".join(f"('{i}', '{r}')" for i, r in enumerate(_REFS)) + r" union all select 'p' || page_id, url from pages), s as (select i, regexp_replace(ref, '^\s+|\s+$', '', 'g') as ref from r) select i, case when regexp_matches(ref, '(?i)^(arxiv:)?\d{4}\.\d{4,5}(v\d+)?$') or regexp_matches(ref, '(?i)arxiv\.org/(abs|html|pdf)/\d{4}\.\d{4,5}') then 'arxiv' when lower(ref) like '%.pdf' then 'pdf' end as adapter from s")
def _(spark, d):
    """References by hand and the pages' addresses."""
    hand = spark.createDataFrame([(str(i), r) for i, r in enumerate(_REFS)], "i string, ref string")
    own = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("i"), F.col("url").alias("ref"))
    return hand.union(own).select("i", text.route(F.col("ref")).alias("adapter"))


_LABELS = ["Table", "table_title", "doc_title", "figure_title", "Page-header", "paragraph", "formula", "abstract", "chart", "number", "table_caption"]


@query("s_categorize", "with l(i, s) as (select 'h' || i, lower(label) from (values " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(_LABELS)) + ") t(i, label) union all select 'p' || p_partkey, lower(label || p_type) from part, (values ('table '), ('title '), ('')) t(label) where p_partkey % 3 = length(label) % 3) select i, case when contains(s, 'table') and not contains(s, 'title') and not contains(s, 'caption') then 'table' when contains(s, 'title') and not contains(s, 'table') and not contains(s, 'figure') and not contains(s, 'chart') and not contains(s, 'image') then 'title' when regexp_matches(s, 'figure|image|chart|formula|equation|header|footer|number|seal|stamp|watermark|aside') then 'drop' else 'text' end as category from l")
def _(spark, d):
    """Labels by hand and of all parts' types, with a word before."""
    hand = spark.createDataFrame([(f"h{i}", r) for i, r in enumerate(_LABELS)], "i string, label string")
    word = spark.createDataFrame([("table ",), ("title ",), ("",)], "word string")
    own = table(spark, d, "part").join(F.broadcast(word), F.col("p_partkey") % 3 == F.char_length("word") % 3).select(F.concat(F.lit("p"), "p_partkey").alias("i"), F.concat("word", "p_type").alias("label"))
    return hand.union(own).select("i", text.layout_category(F.col("label")).alias("category"))


@query("s_needs_ocr", r"select doc_id, length(text) / 2.0 < 100 or length(regexp_replace(text, '\P{L}', '', 'g')) / greatest(length(text), 1) < 0.5 as ocr from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.needs_ocr(F.col("text"), F.lit(2)).alias("ocr"))


@query("s_entity_merge", oracle("entities") + ", a as (select entity_key, uuid, canonical_name, unnest([canonical_name, 'alias ' || (hash_no % 7)]) as name from (select *, length(uuid) as hash_no from entities)), k as (select entity_key, min(uuid) as uuid, arg_min(canonical_name, uuid) as canonical_name, count(distinct uuid) as n from a group by 1) select k.entity_key, k.uuid, k.canonical_name, (select string_agg(distinct name, '|' order by name) from a where a.entity_key = k.entity_key and name <> k.canonical_name) as aliases, k.n from k")
def _(spark, d):
    e = g(spark, d, "entities").withColumn("aliases", F.array(F.concat(F.lit("alias "), F.char_length("uuid") % 7))).withColumn("provenance", F.array("uuid"))
    return dedup.merge_by_key(e).select("entity_key", "uuid", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.size("provenance").cast("long").alias("n"))


@query("s_upsert_uuid", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def _(spark, d):
    return store.upsert(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "value")


_RELS = "rels as (select src, dst, type, '' as rel from edges union all select src, dst, 'OPEN', case when length(dst) % 2 = 0 then 'near' end from edges union all select src, dst, 'OPEN', 'of' from edges)"


@query("s_upsert_edges", oracle("edges", "entities", "facts") + f", {_RELS} select src, dst, type, coalesce(rel, '') as rel from rels where src in (select uuid from entities union all select uuid from facts) and dst in (select uuid from entities where uuid <> 'l3') group by all")
def _(spark, d):
    e, none = g(spark, d, "edges"), F.lit(None).cast("string")
    open_ = lambda rel: e.select("src", "dst", F.lit("OPEN").alias("type"), rel.alias("rel"))
    rels = e.withColumn("rel", F.lit("")).union(open_(F.when(F.char_length("dst") % 2 == 0, "near").otherwise(none))).union(open_(F.lit("of")))
    nodes = g(spark, d, "entities").where("uuid <> 'l3'").select(F.col("uuid").alias("node")).union(g(spark, d, "facts").select("uuid"))
    return store.upsert_edges(rels, nodes).select("src", "dst", "type", "rel")


@query("s_by_key", oracle("entities") + "select uuid, type, canonical_name from entities where entity_key = 'Location:nation_3' order by uuid limit 1")
def _(spark, d):
    return store.by_key(g(spark, d, "entities"), "Location:nation_3")


@query("s_scan_entities", oracle("entities") + "select uuid, type, canonical_name, 'x' || uuid as alias from entities where type <> 'Location' and length(uuid) % 2 = 0")
def _(spark, d):
    """Locations get a type that the model does not know; two graphs share the table."""
    e = g(spark, d, "entities").withColumn("type", F.when(F.col("type") == "Location", "Place").otherwise(F.col("type"))).withColumn("aliases", F.array(F.concat(F.lit("x"), "uuid"))).withColumn("graph_id", (F.char_length("uuid") % 2).cast("string"))
    return store.all_entities(e, "0").select("uuid", "type", "canonical_name", F.array_join("aliases", ",").alias("alias"))


@query("s_scan_facts", oracle("facts") + "select uuid, frame_type, paper_ref, status, year, case when year % 3 = 0 then null else q_value end as value, case when year % 3 > 0 or year % 2 = 0 then q_raw end as raw, year % 3 > 0 or year % 2 = 0 as quantified from facts where year % 5 > 0")
def _(spark, d):
    y = F.col("year")
    f = g(spark, d, "facts").withColumn("q_value", F.when(y % 3 != 0, F.col("q_value"))).withColumn("q_raw", F.when((y % 3 != 0) | (y % 2 == 0), F.col("q_raw")).otherwise("")).withColumn("graph_id", F.when(y % 5 > 0, "a").otherwise("b"))
    return store.all_facts(f, "a").select("uuid", "frame_type", "paper_ref", "status", "year", "quantity.value", "quantity.raw", F.col("quantity").isNotNull().alias("quantified"))


@query("s_scan_edges", oracle("edges") + "select src, dst, type from edges where type <> 'LOCATED_IN'")
def _(spark, d):
    return store.all_edges(g(spark, d, "edges").withColumn("graph_id", F.when(F.col("type") == "LOCATED_IN", "b").otherwise("a")), "a")


@query("s_paper_subgraph", oracle("facts") + "select uuid, frame_type from facts where paper_ref = '7'")
def _(spark, d):
    return store.paper_subgraph(g(spark, d, "facts"), "7")


@query("s_persist", oracle("facts", "entities", "edges") + "select 'facts' as part, uuid as a, case when year = 1995 then 'new' else statement end as b, '' as c from facts union all select 'entities', uuid, case when type = 'Location' then 'new' else canonical_name end, '' from entities union all select 'edges', src, dst, type from (select distinct src, dst, type from edges union select src, 'l1', 'MENTIONS' from edges where dst = 'l2' and type = 'LOCATED_IN')")
def _(spark, d):
    """The facts of a year and all places come again; edges come again too, with new ones, and with some to nowhere."""
    f, e, x = g(spark, d, "facts"), g(spark, d, "entities"), g(spark, d, "edges")
    again = x.where("type = 'LOCATED_IN' and dst = 'l2'").select("src", F.explode(F.array(F.lit("l1"), F.lit("nowhere"))).alias("dst"), F.lit("MENTIONS").alias("type"))
    facts, entities, edges = store.persist(f, e, x, f.where("year = 1995").withColumn("statement", F.lit("new")), e.where("type = 'Location'").withColumn("canonical_name", F.lit("new")), again.union(x.where("type = 'VIA_PROCESS'")))
    part = lambda df, name, a, b, c: df.select(F.lit(name).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"))
    no = F.lit("")
    return part(facts, "facts", F.col("uuid"), F.col("statement"), no).union(part(entities, "entities", F.col("uuid"), F.col("canonical_name"), no)).union(part(edges, "edges", F.col("src"), F.col("dst"), F.col("type")))


_GONE = "gone as (select uuid from facts where paper_ref = '7'), kept as (select * from edges where src not in (select uuid from gone) and dst not in (select uuid from gone))"


@query("s_delete_paper", oracle("facts", "edges", "entities") + f", {_GONE} select 'facts' as part, count(*) as n from facts where paper_ref <> '7' union all select 'edges', count(*) from kept union all select 'entities', count(*) from entities where not (uuid in (select dst from edges where src in (select uuid from gone)) and uuid not in (select dst from kept) and uuid not in (select src from kept))")
def _(spark, d):
    parts = store.delete_paper(g(spark, d, "facts"), g(spark, d, "edges"), g(spark, d, "entities"), "7")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(parts[0], "facts").union(count(parts[1], "edges")).union(count(parts[2], "entities"))


@query("s_supersede", "select doc_id, case when doc_id % 10 = 3 then 'new' else 'old' end as version from documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    return store.supersede(docs.select("doc_id", F.lit("old").alias("version")), docs.where("doc_id % 10 = 3").select("doc_id", F.lit("new").alias("version")), "doc_id")


@query("s_team_ancestors", "with recursive t(id, parent) as (select 'p' || p_partkey, case when p_partkey > 1 then 'p' || (p_partkey // 2) end from part union all values ('x', 'y'), ('y', 'x')), up(id, anc) as (select id, parent from t where parent is not null union select up.id, t.parent from up join t on up.anc = t.id where t.parent is not null) select id, anc from up")
def _(spark, d):
    """A tree of teams as deep as the parts' numbers have bits, and a ring of two."""
    k = F.col("p_partkey")
    tree = table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("id"), F.when(k > 1, F.concat(F.lit("p"), F.expr("p_partkey div 2"))).alias("parent_id"))
    return control.ancestors(tree.union(spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent_id string")))


@query("s_doc", "select doc_id::varchar as paper_ref, '' as title, null::int as year, length(text)::int as n_chars, text as raw_text from documents where doc_id = 7")
def _(spark, d):
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_ref"), F.lit("").alias("title"), F.lit(None).cast("int").alias("year"), F.col("text").alias("raw_text"))
    return store.get_doc(papers, "7")


@query("s_extract_text", r"with l as (select doc_id, text, len(string_split(text, chr(10))) as n_pages, replace(text, chr(10), '') as t from documents where text is not null) select doc_id, t as raw_text, n_pages, length(t) / n_pages < 100 or len(regexp_extract_all(t, '\p{L}')) / greatest(length(t), 1) < 0.5 as ocr_used, case when len(regexp_extract_all(t[:4000], '[\x{0400}-\x{04FF}]')) > len(regexp_extract_all(lower(t[:4000]), '[a-z]')) then 'ru' when regexp_matches(lower(t[:4000]), '[a-z]') then 'en' end as lang from l")
def _(spark, d):
    """Lines stand for pages."""
    pages = lines(spark, d).select(F.col("doc_id").alias("paper_ref"), F.col("n").alias("page"), F.col("line").alias("text"))
    return papers.extract_text(pages).withColumnRenamed("paper_ref", "doc_id")


# joins


@query("j_participants", oracle("edges", "entities") + f", {MEMBERS} select fact, count(*) as n, string_agg(entity, ',' order by entity) as entities from members group by fact")
def _(spark, d):
    return members(spark, d).groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"))


_DETAIL = "t as (select fact, type, string_agg(name, ',' order by name) as names from (select distinct fact, type, name from members) group by 1, 2), parts as (select fact, string_agg(type || ':' || names, ';' order by type) as parts from t group by 1)"


def said(parts: str = "parts"):
    """A map of participants as text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(parts)), lambda x: F.concat(x["key"], F.lit(":"), F.array_join(x["value"], ","))), ";")


@query("j_fact_detail", oracle("edges", "entities", "facts") + f", {MEMBERS}, {_DETAIL} select f.uuid, f.q_raw, f.paper_ref, coalesce(parts, '') as parts from facts f left join parts on fact = f.uuid")
def _(spark, d):
    return graph.fact_detail(g(spark, d, "facts"), members(spark, d)).select("uuid", "q_raw", "paper_ref", said().alias("parts"))


@query("j_link_substr", oracle("entities") + f", {ASK_SQL}, {LINKED} select * from anchors")
def _(spark, d):
    return graph.link_mentions(asked(spark), g(spark, d, "entities"))


_VEC = "select q.vec_id as mention, e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q, embeddings e where q.vec_id % 20 = 0"


@query("j_link_vec", f"select mention, id, score from (select *, row_number() over (partition by mention order by score desc, id) as rank from ({_VEC}) where score >= 0.2) where rank <= 3")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 20 = 0").select(F.col("id").alias("mention"), F.col("embedding").alias("mv"))
    return graph.link_by_vector(q, e, 3, 0.2).select("mention", "id", F.round("score", 6).alias("score"))


@query("j_neardup", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), "embedding")
    return graph.near_pairs(e, 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query("j_stitch_cands", oracle("edges", "facts") + " select distinct c.uuid as claim, k.uuid as measurement from facts c join facts k on c.paper_ref = k.paper_ref and c.frame_type in ('ClaimFact', 'HypothesisFact') and k.frame_type = 'MaterialMeasurement' join edges a on a.src = c.uuid join edges b on b.src = k.uuid and a.dst = b.dst")
def _(spark, d):
    return graph.stitch_candidates(g(spark, d, "facts"), g(spark, d, "edges"))


@query("j_key_bridge", oracle("entities") + "select * from (select uuid as s, lead(uuid) over (partition by entity_key order by uuid) as t from entities) where t is not null")
def _(spark, d):
    return graph.key_bridges(g(spark, d, "entities"))


@query("j_adj", oracle("edges") + "select node, dir, count(*) as n from (select src as node, 'out' as dir from edges union all select dst, 'in' from edges) group by all")
def _(spark, d):
    return graph.adjacency(g(spark, d, "edges")).groupBy("node", "dir").agg(F.count(F.lit(1)).alias("n"))


@query("j_rewire", oracle("edges", "entities") + ", m as (select uuid as old, min(uuid) over (partition by entity_key) as canon from entities), x as (select src, dst, type, null as rel from edges union all select dst, dst, 'OPEN', 'is' from edges) select coalesce(a.canon, src) as src, coalesce(b.canon, dst) as dst, type, rel from x left join m a on src = a.old left join m b on dst = b.old")
def _(spark, d):
    """Every edge, and an open one from each end to itself: loops and parallel edges stay."""
    e = g(spark, d, "edges")
    loops = e.select("dst", "dst", F.lit("OPEN"), F.lit("is"))
    return graph.rewire(e.withColumn("rel", F.lit(None).cast("string")).union(loops), dedup.key_merge(g(spark, d, "entities")))


_TITLE = r"regexp_extract(html, '<title>([^<]*)', 1)"


@query("j_discover_anti", f"with p as (select page_id, {_TITLE} as title from pages), k as (select distinct string_split(text, chr(10))[1] as title from documents) select page_id from p where not exists (select 1 from k where contains(lower(k.title), substring(lower(p.title), 1, 28)) or contains(lower(p.title), substring(lower(k.title), 1, 28)))")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    known = table(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("title")).distinct()
    return graph.discover_new(p, known).select("page_id")


# canonicalisation


@query("g_key_merge", oracle("entities") + "select uuid as old, min(uuid) over (partition by entity_key) as canon from entities")
def _(spark, d):
    return dedup.key_merge(g(spark, d, "entities"))


@query("g_ent_context", oracle("edges", "entities", "facts") + f", {MEMBERS}, r as (select m.entity, f.statement, row_number() over (partition by m.entity order by f.uuid) as k from members m join facts f on m.fact = f.uuid) select entity, string_agg(substring(statement, 1, 120), '; ' order by k) as context from r where k <= 3 group by entity")
def _(spark, d):
    return dedup.contexts(g(spark, d, "facts"), members(spark, d))


_SIG = "sigs as (select f.*, s.sig from facts f join (select src, string_agg(distinct dst, ',' order by dst) as sig from edges where type not in ('SUPPORTED_BY', 'CONTRADICTED_BY', 'SUBTYPE_OF', 'PART_OF') group by src) s on f.uuid = s.src), canon as (select *, min(uuid) over (partition by frame_type, sig, q_value, q_unit, q_operator) as canon from sigs), grp as (select frame_type, sig, count(*) as n, min(uuid) as group_id from canon where uuid = canon group by 1, 2 having count(*) >= 2)"


def _kept(spark, d):
    return dedup.exact_dedup(dedup.signatures(g(spark, d, "facts").select("uuid", *dedup.EQUAL), g(spark, d, "edges")))


@query("g_signature", oracle("facts", "edges") + f", {_SIG} select uuid, sig from sigs")
def _(spark, d):
    return dedup.signatures(g(spark, d, "facts"), g(spark, d, "edges")).select("uuid", "sig")


@query("g_exact_dedup", oracle("facts", "edges") + f", {_SIG} select uuid, canon, uuid = canon as keep from canon")
def _(spark, d):
    return _kept(spark, d).select("uuid", "canon", "keep")


@query("g_conflict_groups", oracle("facts", "edges") + f", {_SIG} select group_id, frame_type, n from grp")
def _(spark, d):
    return dedup.conflict_groups(_kept(spark, d).where("keep")).select("group_id", "frame_type", "n")


@query("g_conflict_participants", oracle("facts", "edges", "entities") + f", {_SIG}, p as (select group_id, unnest(string_split(sig, ',')) as uuid from grp) select group_id, string_agg(coalesce(canonical_name, uuid), '|' order by coalesce(canonical_name, uuid)) as participants from p left join entities using (uuid) group by 1")
def _(spark, d):
    groups = dedup.conflict_groups(_kept(spark, d).where("keep"))
    return dedup.group_participants(groups, g(spark, d, "entities")).select("group_id", F.array_join("participants", "|").alias("participants"))


# Groups are signatures of a part and nothing else here, so that they hold many facts; those of even parts have a verdict: facts 0 and 1 are
# duplicates, 0, 2 and 9 (which few groups have) and 3 and 1 contradict.
_BY_PART = "p as (select *, 'm' || part as sig from facts), r as (select uuid, sig, part, frame_type, row_number() over (partition by frame_type, sig, q_value, q_unit, q_operator order by uuid) as k from p), rep as (select *, count(*) over (partition by frame_type, sig) as n, min(uuid) over (partition by frame_type, sig) as group_id, row_number() over (partition by frame_type, sig order by uuid) - 1 as id from r where k = 1), mem as (select * from rep where n >= 2)"
_LISTED = "lists(kind, list, pos, id) as (values ('duplicates', 0, 0, 0), ('duplicates', 0, 1, 1), ('contradictions', 1, 0, 0), ('contradictions', 1, 1, 2), ('contradictions', 1, 2, 9), ('contradictions', 2, 0, 3), ('contradictions', 2, 1, 1)), told as (select group_id, uuid, kind, list, pos from mem join lists using (id) where part % 2 = 0), gone as (select distinct uuid from (select *, row_number() over (partition by group_id, list order by pos) as r from told where kind = 'duplicates') where r > 1), open as (select group_id, 0 as list, id as pos, uuid from mem where part % 2 = 1 union all select group_id, list, pos, uuid from told where kind = 'contradictions' and uuid not in (select uuid from gone)), head as (select group_id, list, arg_min(uuid, pos) as src from open group by 1, 2)"


def _contested(spark, d):
    f = g(spark, d, "facts").select("uuid", *dedup.EQUAL, F.concat(F.lit("m"), "part").alias("sig"))
    kept = dedup.exact_dedup(f).where("keep")
    groups = dedup.conflict_groups(kept)
    even = groups.where("substr(sig, 2) % 2 = 0").select("group_id")
    rows = [("duplicates", 0, 0, 0), ("duplicates", 0, 1, 1), ("contradictions", 1, 0, 0), ("contradictions", 1, 1, 2), ("contradictions", 1, 2, 9), ("contradictions", 2, 0, 3), ("contradictions", 2, 1, 1)]
    lists = even.crossJoin(F.broadcast(spark.createDataFrame(rows, "kind string, list int, pos int, id int")))  # seven rows
    return dedup.contest(kept, groups, even, lists)


@query("g_contest", oracle("facts") + f", {_BY_PART}, {_LISTED} select distinct src, uuid as dst, 'CONTRADICTED_BY' as type from open join head using (group_id, list) where uuid <> src")
def _(spark, d):
    return _contested(spark, d)[1]


@query("g_contest_status", oracle("facts") + f", {_BY_PART}, {_LISTED} select distinct uuid as fact, 'contested' as status from open union all select uuid, 'gone' from gone")
def _(spark, d):
    status, _, gone = _contested(spark, d)
    return status.union(gone.select("fact", F.lit("gone").alias("status")))


# verification


@query("v_table", oracle("facts") + "select uuid, case when source = 'table' and status <> 'contested' then 'verified' else status end as status, case when source = 'table' and status <> 'contested' then 1.0 else 0.0 end::double as relevance from facts")
def _(spark, d):
    return verify.verify_tables(g(spark, d, "facts")).select("uuid", "status", "relevance")


@query("v_batches", oracle("facts") + "select uuid, paper_ref, (row_number() over (partition by paper_ref order by uuid) - 1) // 25 as batch from facts where source = 'text' and status <> 'contested'")
def _(spark, d):
    return verify.batches(g(spark, d, "facts"))


@query("v_gate", oracle("facts") + "select f.uuid, case when l.doc_id is null or f.status = 'contested' then f.status when round((0.5 + l.quality * 0.4 + 1 - l.toxic) / 3, 9) >= 0.6 and 1 - l.toxic >= 0.4 then 'verified' else 'unverified' end as status from facts f left join labels l on cast(l.doc_id as string) = f.paper_ref")
def _(spark, d):
    f, l = g(spark, d, "facts"), table(spark, d, "labels")
    v = f.select("uuid", "paper_ref").join(l.select(F.col("doc_id").cast("string").alias("paper_ref"), F.lit(0.5).alias("confidence"), (F.col("quality") * 0.4).alias("clarity"), (1.0 - F.col("toxic")).alias("relevance")), "paper_ref").drop("paper_ref")
    return verify.gate(f, v).select("uuid", "status")


@query("v_todo", oracle("facts") + "select uuid from facts where status = 'unverified' and not coalesce(v_checked, false)")
def _(spark, d):
    return verify.todo(g(spark, d, "facts")).select("uuid")


# retrieval


@query("r_overlap", oracle("edges", "entities") + f", {MEMBERS}, {ASK_SQL}, {LINKED} select fact, count(distinct entity) as overlap from members where entity in (select entity from anchors) group by fact")
def _(spark, d):
    return retrieval.overlap(members(spark, d), graph.link_mentions(asked(spark), g(spark, d, "entities")))


_TOP = "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = {q})), 6) as score from embeddings order by score desc, id limit {k}"


def _top(spark, d, q: int, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_top(e.where(F.col("id") == q).first()["embedding"], e, k)  # one row: the question


@query("r_vec30", f"select id, score, row_number() over (order by score desc, id) - 1 as pos from ({_TOP.format(q=5, k=30)})")
def _(spark, d):
    return _top(spark, d, 5, 30).select("id", "score", F.col("pos").cast("long").alias("pos"))


_LISTS = " union all ".join(f"select {i} as list, id, score, row_number() over (order by score desc, id) - 1 as pos from ({_TOP.format(q=q, k=30)})" for i, q in enumerate((5, 6, 7)))


def _lists(spark, d):
    tops = [_top(spark, d, q, 30).withColumn("list", F.lit(i)) for i, q in enumerate((5, 6, 7))]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("r_rrf", f"select id, round(sum(1.0 / (60 + pos)), 6) as rrf from ({_LISTS}) group by id")
def _(spark, d):
    return retrieval.fuse(_lists(spark, d)).select("id", F.round("rrf", 6).alias("rrf"))


@query("r_cut", f"select list, id, score from (select *, max(score) over (partition by list) as best, row_number() over (partition by list order by score desc, id) as rank from ({_LISTS})) where score >= 0.85 * best or rank <= 4")
def _(spark, d):
    return retrieval.relevance_cut(_lists(spark, d), "list").select("list", "id", "score")


@query("r_roundrobin", f"with l as ({_LISTS}), f as (select id, pos, list, row_number() over (partition by id order by pos, list) as r from l) select id, row_number() over (order by pos, list, id) - 1 as pos from f where r = 1")
def _(spark, d):
    return retrieval.round_robin(_lists(spark, d)).select("id", F.col("pos").cast("long").alias("pos"))


@query("r_interleave", f"with t as (select id, row_number() over (order by score desc, id) - 1 as pos, id % 3 = 0 as quantified from ({_TOP.format(q=5, k=30)})), n as (select *, row_number() over (partition by quantified order by pos) as n from t) select id, row_number() over (order by n, quantified desc) - 1 as pos from n")
def _(spark, d):
    return retrieval.interleave(_top(spark, d, 5, 30).withColumn("quantified", F.col("id") % 3 == 0)).select("id", F.col("pos").cast("long").alias("pos"))


def _rounds(n: int) -> str:
    """Scores round by round; what seeds without edges give back follows from their share alone."""
    out = ["iso as materialized (select count(*) filter (where node not in (select a from e)) / greatest(count(*), 1) as f, count(*) as n from seeds)", "s0 as (select node, 1.0::double / n as score, 1.0::double as back from seeds, iso)"]
    back = "1.0::double"
    for i in range(1, n + 1):
        out.append(f"k{i} as materialized (select 0.15 + 0.85 * f * {back} as v from iso{f', k{i - 1}' if i > 1 else ''})")
        back = f"k{i}.v"
        out.append(f"s{i} as materialized (select node, sum(score) as score from (select e.b as node, 0.85 * s.score / deg.deg as score from s{i - 1} s join e on s.node = e.a join deg on deg.a = e.a union all select node, v / n from seeds, iso, k{i}) group by node)")
    return ", ".join(out)


def ppr_sql(pairs: str, seeds: str) -> str:
    """CTEs whose last, s20, holds the scores."""
    e = f"e as materialized (select a, b from ({pairs}) where a <> b union select b, a from ({pairs}) where a <> b), deg as materialized (select a, count(*) as deg from e group by a)"
    return f"seeds as materialized (select distinct node from ({seeds})), {e}, {_rounds(20)}"


BRIDGED = "select src as a, dst as b from edges union all select * from (select uuid as a, lead(uuid) over (partition by entity_key order by uuid) as b from entities) where b is not null"


def _ppr_query(pairs: str) -> str:
    return oracle("edges", "entities", "facts") + f", {ASK_SQL}, {LINKED}, {ppr_sql(pairs, 'select entity as node from anchors union all select $$lonely$$')} select node as fact, round(score, 7) as score from s20 where node in (select uuid from facts) order by round(score, 7) desc, node limit 30"


def _ppr(spark, d, pairs):
    """One seed has no edges."""
    seeds = graph.link_mentions(asked(spark), g(spark, d, "entities")).select(F.col("entity").alias("node")).union(spark.range(1).select(F.lit("lonely")))
    found = retrieval.pagerank(pairs, seeds, wanted=g(spark, d, "facts").select(F.col("uuid").alias("node")), top=30)
    return found.select(F.col("node").alias("fact"), F.round("score", 7).alias("score")).orderBy(F.desc("score"), "fact").limit(30)


@query("r_ppr", _ppr_query("select src as a, dst as b from edges"))
def _(spark, d):
    return _ppr(spark, d, g(spark, d, "edges").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("r_ppr_bridge", _ppr_query(BRIDGED))
def _(spark, d):
    bridges = graph.key_bridges(g(spark, d, "entities")).select(F.col("s").alias("a"), F.col("t").alias("b"))
    return _ppr(spark, d, g(spark, d, "edges").select(F.col("src").alias("a"), F.col("dst").alias("b")).union(bridges))


# the chain of linking, names of its parts, and what the stores and rankings are made of

_NORM = r"rtrim(lower(trim(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '(?i)^(?:[ivxlcdm]+|\d+(?:\.\d+)*|[a-z])[.)]?\s+', ''))), ':')"


@query("t_norm_heading", f"with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents) select doc_id, n, {_NORM} as norm from l")
def _(spark, d):
    return lines(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), text.norm_heading(F.col("line")).alias("norm"))


@query("t_snippet", "select doc_id, case when doc_id % 4 = 0 then '' else trim(text[greatest(0, doc_id % 500 - 160) + 1 : doc_id % 500 + 200]) end as snippet from documents")
def _(spark, d):
    start = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 500).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), start, start + 40).alias("snippet"))


@query("g_ent_context140", oracle("edges", "entities", "facts") + f", {MEMBERS}, r as (select m.entity, f.statement, row_number() over (partition by m.entity order by f.uuid) as k from members m join facts f on m.fact = f.uuid) select entity, string_agg(substring(statement, 1, 140), '; ' order by k) as context from r where k <= 3 group by entity")
def _(spark, d):
    return dedup.contexts(g(spark, d, "facts"), members(spark, d), cap=140)


@query("g_clean_merge", "with c as (select doc_id, list_filter(list_transform(string_split(string_split(text, chr(10))[1], ' '), lambda x: trim(x)), lambda x: x <> '') as names from documents) select doc_id, array_to_string(names, '|') as names from c where len(names) >= 2")
def _(spark, d):
    """The words of a document's first line stand for an answer's cluster."""
    c = table(spark, d, "documents").select("doc_id", F.split(F.substring_index("text", "\n", 1), " ").alias("names"))
    return resolution.clean_clusters(c).select("doc_id", F.array_join("names", "|").alias("names"))


@query("s_upsert_facts", oracle("facts") + "select uuid, case when year = 1995 then q_value + 1 else q_value end as q_value, q_unit, q_operator from facts")
def _(spark, d):
    f = g(spark, d, "facts")
    quantity = lambda v: F.struct(v.cast("double").alias("value"), F.col("q_unit").alias("unit"), F.col("q_operator").alias("operator"), F.col("q_raw").alias("raw"))
    old = f.select("uuid", quantity(F.col("q_value")).alias("quantity"), F.lit(0).alias("seq"))
    new = f.where("year = 1995").select("uuid", quantity(F.col("q_value") + 1).alias("quantity"), F.lit(1).alias("seq"))
    return store.upsert(store.flatten_quantity(old.union(new)), ["uuid"], "seq").select("uuid", "q_value", "q_unit", "q_operator")


@query("s_doc_roundtrip", "select doc_id, n, case when doc_id % 3 = 0 then 'new ' || line else line end as unit from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents) where doc_id % 3 <> 0 or n % 2 = 0")
def _(spark, d):
    """The lists of a third of the papers are replaced by shorter ones; the table is written and read back."""
    own = lines(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), F.col("line").alias("unit"))
    new = own.where("doc_id % 3 = 0 and n % 2 = 0").withColumn("unit", F.concat(F.lit("new "), "unit"))
    return store.cut(store.supersede(own, new, "doc_id"))


@query("r_anchors", oracle("entities") + f", {ASK_SQL}, {LINKED} select entity from anchors union select 'm' || id from ({_TOP.format(q=5, k=30)}) where score >= 0.2")
def _(spark, d):
    near = _top(spark, d, 5, 30).where("score >= 0.2").select(F.concat(F.lit("m"), "id").alias("entity"))
    return retrieval.anchors(graph.link_mentions(asked(spark), g(spark, d, "entities")), near)


@query("r_vsearch", "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 5)), 6) as score from embeddings where label = (select label from embeddings where vec_id = 5) order by score desc, id limit 12")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    q = e.where("id = 5").first()
    return retrieval.vector_top(list(q["embedding"]), e.where(F.col("label") == q["label"]), 12).select("id", "score")


@query("r_ppr_anchors", " union ".join(f"select id from ({_TOP.format(q=q, k=5)})" for q in (5, 6, 7)))
def _(spark, d):
    return retrieval.seeds(_lists(spark, d), 5)


@query("r_top", f"with f as (select id, min((pos, list)) as k from ({_LISTS}) group by id), o as (select id, row_number() over (order by k, id) - 1 as pos from f) select id, pos from o where pos < 12")
def _(spark, d):
    return retrieval.first(retrieval.round_robin(_lists(spark, d)), 3).select("id", F.col("pos").cast("long").alias("pos"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["r_retrieve"](spark, d)


def queries() -> dict[str, Query]:
    from factloom.plans import answers, explorer, knowledge, reading, streams  # noqa: F401  they add their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
