"""Queries about texts' structure, extraction, resolution, concepts and the explorer, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import vocab
from factloom.operators import analytics, concepts, dedup, extraction, graph, resolution, structure
from factloom.plans.fixtures import graph as g
from factloom.plans.fixtures import oracle, table
from factloom.plans.register import query

# texts: every line of a document is turned into one with a mark

_MARKED = {"t_tables": ("Table 7. ", structure.TABLE, "tbl"), "t_figures": ("Fig. 12 ", structure.FIGURE, "fig")}


def _caption_sql(mark: str, pattern: str, tag: str) -> str:
    return rf"""with d as (select doc_id, replace(text, chr(10), chr(10) || '{mark}') as text from documents),
m as (select doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) as hit, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) as n, unnest(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) as gap from d),
p as (select *, coalesce(sum(length(hit) + length(gap)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint + length(gap) as s from m)
select doc_id, '{tag}-' || (n - 1) as ref, s::int as start, (s + length(hit))::int as "end", trim(string_split(text[s + 1 : s + 140], chr(10))[1]) as caption from p"""


def _captions(name: str):
    mark, pattern, tag = _MARKED[name]

    @query(name, _caption_sql(mark, pattern, tag))
    def _(spark, d):
        docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n" + mark)).alias("text"))
        return structure.captions(docs, pattern, tag)


for _name in _MARKED:
    _captions(_name)


@query("t_refs", rf"with d as (select doc_id, 'Body' || chr(10) || '  References ' || chr(10) || '[1] ' || replace(text, chr(10), chr(10) || '12. ') as text from documents), l as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?im)\A(?s:.*?)^\s*references\s*$', ''), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '{structure.REFERENCE}')) as ls from d) select doc_id, 'ref-' || (generate_subscripts(ls, 1) - 1) as ref, unnest(ls)[:300] as raw from l")
def _(spark, d):
    t = F.concat(F.lit("Body\n  References \n[1] "), F.replace("text", F.lit("\n"), F.lit("\n12. ")))
    return structure.references(table(spark, d, "documents").select("doc_id", t.alias("text")))


@query("t_regions", "with d as (select doc_id, length(text) + 60 as n from documents) select doc_id, unnest([5, 10, 20, 25, 30]) as start, unnest([10, 20, 25, 30, n]) as \"end\", unnest([null, 'a', 'b', null, 'c']) as ref from d where n is not null")
def _(spark, d):
    """Each text with sixty characters before it."""
    atom = lambda s, e, r: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(r).alias("ref"))
    n = F.char_length("text") + 60
    atoms = F.array(atom(F.lit(30), n + 9, "c"), atom(F.lit(10), F.lit(20), "a"), atom(F.lit(15), F.lit(25), "b"), atom(F.lit(0), F.lit(5), "z"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", structure.regions(F.lit(5), n, atoms).alias("r"))
    return docs.select("doc_id", F.explode("r").alias("x")).select("doc_id", "x.start", "x.end", "x.ref")


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{structure.WORD}')"


@query("j_source_units", f"with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as unit, unnest(string_split(text, chr(10))) as line from documents), u as (select distinct doc_id, unit, unnest({_words('line')}) as word from l), s as (select distinct doc_id, unnest({_words('text[:200]')}) as word from documents), n as (select doc_id, unit, count(*) as n from s join u using (doc_id, word) group by 1, 2), r as (select *, row_number() over (partition by doc_id order by n desc, unit) as r from n) select doc_id as uuid, string_agg(line, chr(10) || '---' || chr(10) order by r)[:1400] as source from r join l using (doc_id, unit) where r <= 2 group by doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_ref"), "text")
    units = docs.select("paper_ref", F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    return structure.source_passages(units, docs.select(F.col("paper_ref").alias("uuid"), "paper_ref", F.substring("text", 1, 200).alias("statement")))


# extraction


def _frames(spark, d):
    none = F.lit(None).cast("string")
    about = F.array(F.struct(F.col("mention"), F.col("mention_type").alias("type")), F.struct(F.lit(" ").alias("mention"), F.lit("Material").alias("type")))
    rels = F.array(F.struct(F.col("material").alias("src"), F.lit("drives").alias("rel"), F.col("location").alias("dst")), F.struct(none.alias("src"), F.lit("x").alias("rel"), F.lit("y").alias("dst")))
    slots = F.create_map(F.lit("material"), "material", F.lit("process"), "process", F.lit("location"), "location", F.lit("mood"), "mention")
    n = F.char_length("material")
    quantity = F.struct(n.cast("double").alias("value"), F.lit("mm").alias("unit"), F.lit("~").alias("operator"), *[none.cast("double").alias(c) for c in ("uncertainty", "lower", "upper")], none.alias("raw"))
    more = (F.lit("table").alias("source"), n.alias("year"), F.when(n % 2 == 0, quantity).alias("quantity"))
    return g(spark, d, "frames").select("chunk", "ord", "paper_ref", "frame_type", slots.alias("slots"), about.alias("about"), rels.alias("open_edges"), "statement", "negated", *more)


_TYPED = "t as (select *, case when frame_type = 'Rumour' then 'ClaimFact' else frame_type end as ft from frames)"
_MENTIONED = f"{_TYPED}, mm as (" + " union all ".join(f"select sha1(concat_ws('|', chunk, ord)) as fact, paper_ref, '{s}' as place, {s} as mention, '{e}' as type, '{x}' as edge from t where ft = '{f}' and trim(coalesce({s}, '')) <> ''" for f, s, e, x in vocab.SLOTS if s in ("material", "process", "location")) + " union all select sha1(concat_ws('|', chunk, ord)), paper_ref, 'about-0', mention, mention_type, 'MENTIONS' from t where mention_type = 'Person')"


@query("x_clean", oracle("frames") + f", {_TYPED} select chunk, ft as frame_type, 2 + (trim(process) <> '')::int + (location is not null)::int as slots, (mention_type = 'Person')::int as about, (location is not null)::int as open_edges, coalesce(statement, '') as statement, coalesce(negated, false) as negated from t")
def _(spark, d):
    return extraction.clean(_frames(spark, d)).select("chunk", "frame_type", F.size("slots").alias("slots"), F.size("about").alias("about"), F.size("open_edges").alias("open_edges"), "statement", "negated")


@query("x_slots", "select * from (values " + ", ".join(str(s) for s in vocab.SLOTS) + ") t(frame_type, slot, type, edge)")
def _(spark, d):
    return extraction.slot_table(spark)


@query("x_build_facts", oracle("frames") + f", {_TYPED} select sha1(concat_ws('|', chunk, ord)) as uuid, ft as frame_type, paper_ref, statement, material as anchor, coalesce(negated, false) as negated, 'table' as source, length(material)::int as year, case when length(material) % 2 = 0 then length(material)::double end as value, case when length(material) % 2 = 0 then 'mm' end as unit, 'unverified' as status from t")
def _(spark, d):
    f = extraction.build(extraction.clean(_frames(spark, d)))[0]
    return f.select("uuid", "frame_type", "paper_ref", "statement", "anchor", "negated", "source", "year", "quantity.value", "quantity.unit", "status")


@query("x_provenance", r'''with d as (select doc_id, 'About  it:' || chr(10) || text as raw from documents where text is not null), w as (select doc_id, raw, string_split(trim(regexp_replace(raw, '\s+', ' ', 'g')), ' ') as ws from d), r as (select doc_id, raw, array_to_string(ws[3:5], ' ') as anchor, list_aggregate(list_transform(ws[3:5], lambda x: regexp_escape(x)), 'string_agg', '\s+') as a from w), m as (select doc_id, raw, case when doc_id % 4 = 0 then 'nowhere' else anchor end as anchor, case when doc_id % 4 > 0 and anchor <> '' then regexp_extract(raw, a) end as hit from r) select 'f' || doc_id as uuid, sha1(raw) as text_hash, case when coalesce(hit, '') = '' then 3 else instr(raw, hit) - 1 end::int as start, case when coalesce(hit, '') = '' then 9 else instr(raw, hit) - 1 + length(hit) end::int as "end", nullif(anchor, '') as anchor from m''')
def _(spark, d):
    """Words 3 to 5 of a text are its fact's anchor; every fourth fact's stands nowhere, and the chunk's span is taken."""
    raw = F.concat(F.lit("About  it:\n"), "text")
    papers = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("paper_ref"), F.lit("").alias("title"), raw.alias("raw_text"))
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("raw_text", r"(?U)\s+", " ")), " "), 3, 3), " ")
    facts = papers.select(F.concat(F.lit("f"), "paper_ref").alias("uuid"), "paper_ref", F.col("paper_ref").alias("chunk"), F.when(F.col("paper_ref") % 4 == 0, "nowhere").otherwise(words).alias("anchor"))
    chunks = papers.select(F.col("paper_ref").alias("chunk"), F.lit(3).alias("start"), F.lit(9).alias("end"))
    return extraction.provenance(facts, chunks, papers).select("uuid", "text_hash", "start", "end", "anchor")


@query("x_build_entities", oracle("frames") + rf", {_MENTIONED} select sha1(concat_ws('|', fact, place)) as uuid, type, trim(mention) as canonical_name, type || ':' || regexp_replace(lower(trim(mention)), '\s+', '-', 'g') as entity_key from mm")
def _(spark, d):
    return extraction.build(extraction.clean(_frames(spark, d)))[1].drop("paper_ref")


@query("x_build_edges", oracle("frames") + f", {_MENTIONED} select fact as src, sha1(concat_ws('|', fact, place)) as dst, edge as type from mm")
def _(spark, d):
    return extraction.build(extraction.clean(_frames(spark, d)))[2]


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 5 == 0, "other").when(F.col("doc_id") % 5 == 1, "method").alias("role_hint"), F.when(F.col("doc_id") % 3 == 0, "tbl-0").alias("atomic_ref"), F.lit(100).alias("start"), (F.char_length("text") + 100).alias("end"), "text")


@query("x_s3", "select l.doc_id as chunk, quality, case when l.doc_id % 3 = 0 then 'table' else 'text' end as source, case when quality = 1 then 'MaterialMeasurement' else 'ClaimFact' end as frame_type from labels l join documents d on l.doc_id = d.doc_id where l.doc_id % 5 <> 0 and (l.doc_id % 3 > 0 or quality = 1)")
def _(spark, d):
    told = table(spark, d, "labels").select(F.col("doc_id").alias("chunk"), "quality", F.when(F.col("quality") == 1, "MaterialMeasurement").otherwise("ClaimFact").alias("frame_type"))
    return extraction.frames_of(_chunks(spark, d), told).select("chunk", "quality", "source", "frame_type")


@query("x_roles", r'''with d as (select doc_id, text, length(text) as n, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as ws from documents where text is not null), p as (select *, array_to_string(ws[3:6], ' ') as anchor, list_aggregate(list_transform(ws[3:6], lambda x: regexp_escape(x)), 'string_agg', '\s+') as a from d), h as (select *, case when doc_id % 3 > 0 and doc_id % 2 = 0 and doc_id % 7 <> 1 and anchor <> '' then regexp_extract(text, a) end as hit from p) select doc_id || '-u0' as unit_id, doc_id as chunk, case when coalesce(hit, '') = '' then 100 else 99 + instr(text, hit) end::int as start, case when coalesce(hit, '') = '' then 100 + n else 99 + instr(text, hit) + length(hit) end::int as "end", case when doc_id % 3 = 0 then 'result' when doc_id % 2 = 0 then 'claim' else 'other' end as role, case when doc_id % 3 = 0 then 0.5 when doc_id % 2 = 0 then 0.9 else 0.0 end::double as confidence from h''')
def _(spark, d):
    """Words 3 to 6 with single blanks between them are the anchors, whatever stands between them in the text."""
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), 3, 4), " ")
    tags = table(spark, d, "documents").where("doc_id % 2 = 0 and text is not null").select(F.col("doc_id").alias("chunk"), F.lit(0).alias("ord"), F.when(F.col("doc_id") % 7 == 1, "no such passage").otherwise(words).alias("anchor"), F.lit("claim").alias("role"), F.lit(0.9).alias("confidence"))
    return extraction.units(_chunks(spark, d).where("text is not null"), tags)


@query("x_section_roles", "select doc_id, case when doc_id % 4 = 0 then 'method' when lang = 'body' then null when source = (select max(source) from documents) then 'claim' end as role_hint from documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    told = docs.agg(F.upper(F.max("source")).alias("title")).withColumn("role", F.lit("claim"))
    return extraction.label_sections(docs.select("doc_id", F.col("source").alias("name"), F.when(F.col("doc_id") % 4 == 0, "method").alias("role_hint")), told).select("doc_id", "role_hint")


# resolution


def _grouped(spark, d):
    return g(spark, d, "entities").select(F.col("type").alias("grp"), "uuid", "canonical_name", F.array(F.concat(F.lit("alias "), F.col("uuid"))).alias("aliases"))


def _clusters(spark, d):
    """Facilities by threes, each called by an alias; Locations in clusters of one."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.lit("Facility").alias("grp"), F.floor(k / 3).cast("long").alias("cluster"), (k % 3).cast("long").alias("pos"), F.concat(F.lit("alias f"), k).alias("name")).union(table(spark, d, "nation").select(F.lit("Location"), F.col("n_nationkey").cast("long"), F.lit(0).cast("long"), "n_name"))


_MAP = "mp as (select 'f' || s_suppkey as old, 'f' || first_value(s_suppkey) over (partition by s_suppkey // 3 order by s_suppkey) as canon from supplier)"


@query("g_resolve", f"with {_MAP} select * from mp where old <> canon")
def _(spark, d):
    return resolution.merges(_grouped(spark, d), _clusters(spark, d))


@query("g_resolve_relations", f"with {_MAP}, w as (select a.canon as src, b.canon as dst from supplier s join mp a on a.old = 'f' || s.s_suppkey join mp b on b.old = 'f' || (s.s_suppkey + 1)) select distinct src, dst, 'PART_OF' as type from w where src <> dst and src <> 'f3'")
def _(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    asked = s.select(F.lit("Facility").alias("grp"), F.concat(F.lit("alias f"), k).alias("child"), F.concat(F.lit("alias f"), k + 1).alias("parent"), F.lit("part_of").alias("rel")).union(s.select(F.lit("Facility"), F.lit("alias f1"), F.lit("alias f9"), F.lit("IS_LIKE")))
    known = spark.createDataFrame([("f3", "f6", "PART_OF")], "src string, dst string, type string")
    return resolution.relations(_grouped(spark, d), known, asked, resolution.merges(_grouped(spark, d), _clusters(spark, d)))


@query("g_canon", oracle("edges") + "select src, dst, case when type = 'LOCATED_IN' then 'IS_A' else 'OPEN' end as type, case when type <> 'LOCATED_IN' then type end as rel, case when type <> 'LOCATED_IN' then 'd' end as rel_def from edges")
def _(spark, d):
    told = spark.createDataFrame([("LOCATED_IN", "IS_A"), ("CONDUCTED_BY", "NONSENSE")], "rel string, core_type string")
    open_ = g(spark, d, "edges").select("src", "dst", F.lit("OPEN").alias("type"), F.col("type").alias("rel"), F.lit("d").alias("rel_def"))
    return resolution.canon_predicates(open_, told, vocab.NON_PARTICIPANT)


_PAIRS = "c as (select distinct a.uuid as claim, b.uuid as measurement from facts a join facts b on a.paper_ref = b.paper_ref and a.frame_type = 'ClaimFact' and b.frame_type = 'SynthesisProcedure')"


@query("g_stitch", oracle("facts") + f", {_PAIRS} select claim as src, measurement as dst, 'SUPPORTED_BY' as type from c where measurement in (select uuid from facts where q_value > 25)")
def _(spark, d):
    f = g(spark, d, "facts")
    c = f.where("frame_type = 'ClaimFact'").select(F.col("uuid").alias("claim"), "paper_ref").join(f.where("frame_type = 'SynthesisProcedure'").select(F.col("uuid").alias("measurement"), "paper_ref", "q_value"), "paper_ref")
    return resolution.stitch(c.select("claim", "measurement"), c.where("q_value > 25").select("claim", "measurement"))


# the whole chain: entities by key, places by pairs, PART_OF between places, one relation named; conflicts whose first fact's id is below
# 8 have a verdict, and measurements with such ids support claims

_S4 = """, k as (select uuid as old, min(uuid) over (partition by entity_key) as one from entities),
mp as (select old, case when one[1:1] = 'l' then 'l' || (substr(one, 2)::int // 2 * 2) else one end as canon from k),
e2 as (select coalesce(a.canon, src) as src, coalesce(b.canon, dst) as dst, case when type = 'VIA_PROCESS' then 'AFFECTS' else type end as type from edges left join mp a on a.old = src left join mp b on b.old = dst),
e3 as materialized (select * from e2 union all select distinct x.canon, y.canon, 'PART_OF' from nation n join mp x on x.old = 'l' || n_nationkey join mp y on y.old = 'l' || (n_nationkey + 2) where x.canon <> y.canon),
sg as (select src, string_agg(distinct dst, ',' order by dst) as sig from e3 where type not in ('SUPPORTED_BY', 'CONTRADICTED_BY', 'SUBTYPE_OF', 'PART_OF') group by 1),
sf as materialized (select f.*, sig, min(uuid) over (partition by frame_type, sig, q_value, q_unit, q_operator) as canon from facts f join sg on src = uuid),
rep as materialized (select *, count(*) over (partition by frame_type, sig) as n, min(uuid) over (partition by frame_type, sig) as group_id, row_number() over (partition by frame_type, sig order by uuid) - 1 as id from sf where uuid = canon),
gone as materialized (select uuid from sf where uuid <> canon union select uuid from rep where n >= 2 and group_id < '8' and id = 1),
con as materialized (select uuid, group_id, id from rep where n >= 2 and group_id >= '8'),
kept as materialized (select uuid, frame_type, paper_ref, case when uuid in (select uuid from con) then 'contested' else status end as status from facts where uuid not in (select uuid from gone)),
e4 as materialized (select * from e3 where src not in (select uuid from gone) and dst not in (select uuid from gone) union all select group_id, uuid, 'CONTRADICTED_BY' from con where id > 0),
sup as (select distinct c.uuid as src, m.uuid as dst from kept c join kept m on c.paper_ref = m.paper_ref and c.frame_type in ('ClaimFact', 'HypothesisFact') and m.frame_type = 'MaterialMeasurement' join e4 a on a.src = c.uuid join e4 b on b.src = m.uuid and a.dst = b.dst where m.uuid < '8')"""


def _s4(spark, d):
    f, e, x = g(spark, d, "facts"), g(spark, d, "entities"), g(spark, d, "edges")
    via = F.col("type") == "VIA_PROCESS"
    open_ = x.select("src", "dst", F.when(via, "OPEN").otherwise(F.col("type")).alias("type"), F.when(via, "via").alias("rel"), F.when(via, "by way of").alias("rel_def"))
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    places = n.select(F.lit("Location").alias("grp"), F.floor(k / 2).cast("long").alias("cluster"), (k % 2).cast("long").alias("pos"), F.col("n_name").alias("name"))
    above = n.select((k - 2).alias("below"), F.col("n_name").alias("parent"))
    relations = n.join(above, k == F.col("below")).select(F.lit("Location").alias("grp"), F.col("n_name").alias("child"), "parent", F.lit("part_of").alias("rel"))
    answered = f.where("uuid < '8'").select(F.col("uuid").alias("group_id"))
    lists = answered.select("group_id", F.lit("duplicates").alias("kind"), F.lit(0).alias("list"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("id", F.col("pos"))
    claims = f.where("frame_type in ('ClaimFact', 'HypothesisFact')").select(F.col("uuid").alias("claim"), "paper_ref")
    approved = claims.join(f.where("frame_type = 'MaterialMeasurement' and uuid < '8'").select(F.col("uuid").alias("measurement"), "paper_ref"), "paper_ref").select("claim", "measurement")
    return dedup.link_chain(f, e, open_, places, relations, spark.createDataFrame([("via", "AFFECTS")], "rel string, core_type string"), answered, lists, approved)


@query("g_s4", oracle("entities", "edges", "facts") + f"{_S4} select uuid, frame_type, status from kept")
def _(spark, d):
    return _s4(spark, d)[0].select("uuid", "frame_type", "status")


@query("g_s4_entities", oracle("entities", "edges", "facts") + f"{_S4} select canon as uuid, max(canonical_name) filter (where old = canon) as canonical_name, coalesce(string_agg(distinct canonical_name, '|' order by canonical_name) filter (where canonical_name <> (select canonical_name from entities c where c.uuid = canon)), '') as aliases from mp join entities on uuid = old group by canon")
def _(spark, d):
    return _s4(spark, d)[1].select("uuid", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query("g_s4_edges", oracle("entities", "edges", "facts") + f"{_S4} select src, dst, type from e4 union all select src, dst, 'SUPPORTED_BY' from sup")
def _(spark, d):
    return _s4(spark, d)[2].select("src", "dst", "type")


# concepts

_NEAR = "select item, concept, score, row_number() over (partition by item order by score desc, concept) - 1 as pos from (select a.vec_id as item, b.vec_id as concept, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where score >= 0.1"


def _cands(spark, d, every: int = 1):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), "embedding")
    return concepts.candidates(e.where(F.col("id") % every == 0), e, least=0.1)


@query("c_topk", f"select item, concept, round(score, 6) as score from ({_NEAR.replace(' where a.vec_id % 20 = 0', '')}) where pos < 6")
def _(spark, d):
    """Every vector asks."""
    return _cands(spark, d).select("item", "concept", F.round("score", 6).alias("score"))


@query("c_match", f"select item, concept from ({_NEAR}) where pos < 6 and pos = item % 3")
def _(spark, d):
    c = _cands(spark, d, 20)
    return concepts.match(c, c.select("item", (F.col("item") % 3).cast("int").alias("pos")).distinct())


@query("c_components", "select p_partkey as node, min(p_partkey) over (partition by (p_partkey + 9) // 10) as comp from part")
def _(spark, d):
    k = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    pairs = k.where("node % 10 <> 0").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(k.select(F.col("node").alias("b")), "b", "left_semi")
    return concepts.components(k, pairs)


# Near entities are embeddings of one label: canopies at 0.25 and clusters at 0.3. A speaker whose number is divisible by 3 is answered with the
# nearest earlier one; names with two quantities found nothing.

_ITEMS = "it as (select vec_id as id, label as type, embedding::double[] as e, case when vec_id % 11 = 0 then '5 W at 6 nm' else 'name ' || vec_id end as name from embeddings)"
_PAIRED = "np as materialized (select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as s from it a join it b on a.type = b.type and a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.25)"
_CLUSTERED = "cr(a, b) as (select a, b from np where s >= 0.3 union select b, a from np where s >= 0.3 union select cr.a, p.y from cr join (select a as x, b as y from np where s >= 0.3 union select b, a from np where s >= 0.3) p on cr.b = p.x), cl as materialized (select id as node, least(id, coalesce(min(b), id)) as comp from it left join cr on cr.a = id group by id)"
_FOUND = "hd as (select id, name from it join cl on id = node where node = comp), an as (select b as id, max(a) as told from np where b % 3 = 0 group by 1), st(id, told, fit, k) as (select hd.id, an.told, name not like '5 W%', row_number() over (order by hd.id) from hd left join an on an.id = hd.id), run(k, founds, placed) as (select 0::bigint, []::bigint[], []::bigint[][] union all select st.k, case when (told is null or not list_contains(founds, told)) and fit then list_append(founds, st.id) else founds end, case when told is not null and list_contains(founds, told) then list_append(placed, [st.id, told]) else placed end from run join st on st.k = run.k + 1), fin as (select founds, placed from run order by k desc limit 1), pl as materialized (select unnest(founds) as id, unnest(founds) as concept from fin union all select p[1], p[2] from (select unnest(placed) as p from fin))"


def _items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), "embedding")


def _found(spark, d):
    items = _items(spark, d)
    _, clusters, near = concepts.canopies(items, 0.25, 0.3)
    named = items.select(F.col("id").alias("uuid"), "type", F.when(F.col("id") % 11 == 0, "5 W at 6 nm").otherwise(F.concat(F.lit("name "), "id")).alias("canonical_name"))
    told = near.where("b % 3 = 0").groupBy(F.col("b").alias("item")).agg(F.max("a").alias("concept"))
    return concepts.found_concepts(named, clusters, told, near)


@query("c_canopy", f"with recursive {_ITEMS}, {_PAIRED}, {_CLUSTERED}, {_FOUND} select node as entity, concept from cl join pl on pl.id = comp")
def _(spark, d):
    return _found(spark, d)[1]


@query("c_new", f"with recursive {_ITEMS}, {_PAIRED}, {_CLUSTERED}, {_FOUND} select pl.id as concept, name, type from pl join it on it.id = pl.id where pl.id = pl.concept")
def _(spark, d):
    return _found(spark, d)[0]


@query("c_canopies", f"with recursive {_ITEMS}, {_PAIRED}, cr(a, b) as (select a, b from np union select b, a from np union select cr.a, p.y from cr join (select a as x, b as y from np union select b, a from np) p on cr.b = p.x) select id as node, least(id, coalesce(min(b), id)) as comp from it left join cr on cr.a = id group by id")
def _(spark, d):
    return concepts.canopies(_items(spark, d), 0.25, 0.3)[0]


@query("c_maturity", oracle("facts") + ", r as (select supp, uuid, frame_type, row_number() over (partition by supp order by uuid) as r from facts), s as (select supp, count(*) as n, max(frame_type) filter (where r = 1) as a, max(frame_type) filter (where r = 2) as b, max(frame_type) filter (where r = 3) as c from r group by supp), t as (select supp, n, c, case when b is null or contains(a, b) then a else a || ' | ' || b end as ab from s) select supp as concept, n, case when c is null or contains(ab, c) then ab else ab || ' | ' || c end as context, n >= 3 as mature from t")
def _(spark, d):
    return concepts.maturity(g(spark, d, "facts").select(F.col("supp").alias("concept"), F.col("uuid").alias("seq"), F.col("frame_type").alias("context")))


_TREE = "tree as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1)"
_UP = f"with recursive {_TREE}, up(child, ancestor) as (select child, parent from tree union select up.child, t.parent from up join tree t on up.ancestor = t.child)"


def _tree(spark, d):
    return table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


@query("c_reach", f"{_UP} select child, ancestor from up")
def _(spark, d):
    return concepts.closure(_tree(spark, d))


@query("c_place", f"{_UP}, w as (select child, parent - 1 as parent from tree where parent > 1 union all select parent, child from tree) select child, parent from w where child <> parent and not exists (select 1 from up where up.child = w.parent and up.ancestor = w.child)")
def _(spark, d):
    t = _tree(spark, d)
    return concepts.place(t, t.where("parent > 1").select("child", (F.col("parent") - 1).alias("parent")).union(t.select("parent", "child")))


@query("c_reduce", f"with {_TREE}, added as (select * from tree where child % 4 <> 1), direct as (select child, parent // 2 as parent from tree where parent > 1) select child, parent from (select * from direct union select * from added) e where not exists (select 1 from added a join added b on a.parent = b.child where a.child = e.child and b.parent = e.parent)")
def _(spark, d):
    t = _tree(spark, d)
    return concepts.reduce(t.where("parent > 1").select("child", F.expr("parent div 2").alias("parent")), t.where("child % 4 <> 1"))


@query("c_merge", f"with {_TREE}, m as (select case when child % 7 = 0 then child - 1 else child end as child, case when parent % 7 = 0 and parent > 0 then parent - 1 else parent end as parent from tree) select distinct child, parent from m where child <> parent")
def _(spark, d):
    t = _tree(spark, d)
    return concepts.merge(t, t.where("child % 7 = 0").select(F.col("child").alias("dup"), (F.col("child") - 1).alias("keep")))


# Parts are concepts in a chain by their numbers' halves; those that end on 3 are the same as the one before, those that end on 4 the same as
# the one before (which has gone), those that end on 5 below the one before (which stays or not), and those that end on 6 above their half.

_VERDICTS = "ans as (select p_partkey as concept, case p_partkey % 10 when 6 then p_partkey // 2 else p_partkey - 1 end as other, case p_partkey % 10 when 3 then 'same' when 4 then 'same' when 5 then 'parent' else 'child' end as rel from part where p_partkey % 10 between 3 and 6 and p_partkey > 6), dup as (select concept as dup, other as keep from ans where concept % 10 = 3)"
_MAPPED = "kept as (select distinct coalesce(a.keep, child) as child, coalesce(b.keep, parent) as parent from tree left join dup a on a.dup = child left join dup b on b.dup = parent where coalesce(a.keep, child) <> coalesce(b.keep, parent))"


def _hierarchy(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    known = p.select(k.alias("concept"), F.lit(3).cast("long").alias("n"), F.lit(False).alias("done"))
    digit = k % 10
    answers = p.where(digit.between(3, 6) & (k > 6)).select(k.alias("concept"), F.when(digit == 6, F.expr("p_partkey div 2")).otherwise(k - 1).alias("other"), F.when(digit <= 4, "same").when(digit == 5, "parent").otherwise("child").alias("rel"))
    return concepts.hierarchy(known, _tree(spark, d), p.select(F.concat(F.lit("e"), k).alias("entity"), k.alias("concept")), answers)


# a concept ending on 4 names one that went before its turn: it stays; one ending on 5 is below it; one ending on 6 would be above its half,
# which is above it already, so that closes a cycle


@query("c_hierarchy", f"with {_TREE}, {_VERDICTS}, {_MAPPED}, added as (select concept as child, other as parent from ans where rel = 'parent') select child, parent from (select * from kept union select * from added) e where not exists (select 1 from added a join added b on a.parent = b.child where a.child = e.child and b.parent = e.parent)")
def _(spark, d):
    return _hierarchy(spark, d)[1]


@query("c_hierarchy_instances", f"with {_TREE}, {_VERDICTS} select 'e' || p_partkey as entity, coalesce(keep, p_partkey) as concept from part left join dup on dup = p_partkey")
def _(spark, d):
    return _hierarchy(spark, d)[2]


@query("c_hierarchy_concepts", f"with {_TREE}, {_VERDICTS} select p_partkey as concept, 1 + count(dup) as n, true as done from part left join dup on keep = p_partkey where p_partkey not in (select dup from dup) group by 1")
def _(spark, d):
    return _hierarchy(spark, d)[0].select("concept", "n", "done")


@query("c_persist", f"with {_TREE}, {_VERDICTS} select 'e' || p_partkey as src, 'c' || coalesce(keep, p_partkey) as dst, 'INSTANCE_OF' as type from part left join dup on dup = p_partkey union all select distinct 'c' || child, 'c' || parent, 'SUBTYPE_OF' from tree")
def _(spark, d):
    i = _hierarchy(spark, d)[2]
    c = lambda x: F.concat(F.lit("c"), x)
    t = _tree(spark, d)
    none = i.select("concept", F.lit("").alias("name"), F.lit("").alias("type"), F.lit("").alias("context"), F.lit(1).alias("n"), F.lit(True).alias("mature"), F.lit(True).alias("done"))
    twice = t.union(t).select(c(F.col("child")).alias("child"), c(F.col("parent")).alias("parent"))
    return concepts.rows_to_persist(none, i.select("entity", c(F.col("concept")).alias("concept")), twice)[1].drop("rel")


# explorer

_TOKENS = ["ring", "nation_1", "order 7 "]
_BODIES = "bodies as (select uuid as node, lower(canonical_name) as body, false as finding, cast(null as varchar) as place from entities union all select uuid, lower(statement), true, case when year % 2 = 0 then cast(year as varchar) end from facts)"
_COUNT = " + ".join(f"(length(body) - length(replace(body, '{t}', ''))) // {len(t)}" for t in _TOKENS)
_ADJ = "adj as (select src as node, dst as other from edges union select dst, src from edges)"


def _bodies(spark, d):
    e, f = g(spark, d, "entities"), g(spark, d, "facts")
    none = F.lit(None).cast("string")
    return e.select(F.col("uuid").alias("node"), F.col("canonical_name").alias("body"), F.lit(False).alias("finding"), none.alias("place")).union(f.select("uuid", "statement", F.lit(True), F.when(F.col("year") % 2 == 0, F.col("year").cast("string"))))


@query("a_graphrag", oracle("entities", "facts", "edges") + f", {_BODIES}, {_ADJ}, top as (select node, ({_COUNT})::double as score from bodies where {_COUNT} > 0 order by score desc, node limit 8), few as (select node, other from (select *, row_number() over (partition by node order by other) as r from adj where node in (select node from top)) where r <= 6) select node, score from (select * from top union all select distinct other, 0.3::double from few where other not in (select node from top)) order by score desc, node limit 16")
def _(spark, d):
    return analytics.graph_rag(_bodies(spark, d), graph.adjacency(g(spark, d, "edges")), _TOKENS)


@query("a_litreview", oracle("entities", "facts", "edges") + f", {_BODIES}, {_ADJ}, sc as (select *, {_COUNT} as score from bodies), top as (select node from sc where not finding and score > 0 order by score desc, node limit 10), own as (select node, coalesce(place, '') as place from sc where finding and (score > 0 or node in (select other from adj where node in (select node from top)))), dis as (select uuid as a, lead(uuid) over (partition by paper_ref order by uuid) as b from facts where status = 'contested'), hit as (select a, b from dis where b is not null and (a in (select node from own) or b in (select node from own))) select node, place, node in (select a from hit union all select b from hit) as contested from own")
def _(spark, d):
    f = g(spark, d, "facts").where("status = 'contested'")
    disputed = graph.key_bridges(f.select("uuid", F.col("paper_ref").alias("entity_key"))).select(F.col("s").alias("a"), F.col("t").alias("b"))
    return analytics.literature(_bodies(spark, d), graph.adjacency(g(spark, d, "edges")), disputed, _TOKENS)


@query("a_compare", oracle("entities") + "select key, case key when 'name' then 1 when 'type' then 2 else 3 end as pos, max(value) filter (where uuid = 'm1') as m1, max(value) filter (where uuid = 'f1') as f1 from (select uuid, unnest(['name', 'type', 'entity_key']) as key, unnest([canonical_name, type, entity_key]) as value from entities) where uuid in ('m1', 'f1') group by key")
def _(spark, d):
    e = g(spark, d, "entities").select(F.col("uuid").alias("node"), F.col("canonical_name").alias("name"), "type", "entity_key")
    return analytics.compare(e.unpivot("node", ["name", "type", "entity_key"], "key", "value"), ["m1", "f1"], ["name", "type"])


@query("a_catalog", "select p_partkey as item, contains(lower(p_name || ' ' || p_type), 'ring')::bigint + contains(lower(p_name || ' ' || p_type), 'economy')::bigint as score from part where contains(lower(p_name || ' ' || p_type), 'ring') or contains(lower(p_name || ' ' || p_type), 'economy') order by score desc, item limit 6")
def _(spark, d):
    return analytics.catalogue(table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_type").alias("body")), ["ring", "economy"])
