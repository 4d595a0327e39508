"""Queries about whole papers, anchors, answers and what leaves the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import anchors
from factloom.operators import answers, dedup, graph, papers, retrieval, verify
from factloom.plans.catalog import ASK_SQL, BRIDGED, LINKED, MEMBERS, asked, members, ppr_sql, said
from factloom.plans.fixtures import HEAD, oracle, table
from factloom.plans.fixtures import graph as g
from factloom.plans.register import query
from factloom.sources import exports, store, vectorindex

# whole papers: lines stand for regions of a layout, their category comes from their length

_KIND = "case when length(t) % 7 = 0 then 'title' when length(t) % 7 = 3 then 'table' else 'text' end"
_REGIONS = rf"l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as t from documents), p as (select doc_id, n, t, {_KIND} as kind, (sum(length(t) + 1) over (partition by doc_id order by n))::bigint - 1 as e from l where t <> '')"


def _regions(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("paper_ref"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n = F.char_length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) % 7
    return lines.withColumn("category", F.when(n == 0, "title").when(n == 3, "table").otherwise("text"))


@query("s_assemble", rf"""with {_REGIONS}, a as (select doc_id, min(e - length(t)) filter (kind = 'title') as head, max(e) as total from p group by 1), s as (select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g'))[:80] as name, e - length(t) as s, coalesce(lead(e - length(t)) over (partition by doc_id order by n), total) as e from p join a using (doc_id) where kind = 'title' union all select doc_id, case when head is null then 'body' else 'frontmatter' end, 0, coalesce(head, total, 0) from (select distinct doc_id from l) left join a using (doc_id) where head is null or head > 0) select doc_id, 'sec-' || (row_number() over (partition by doc_id order by s) - 1) as ref, name, s as start, e as "end" from s union all select doc_id, 'tbl-' || (row_number() over (partition by doc_id order by n) - 1), t[:120], e - length(t), e from p where kind = 'table'""")
def _(spark, d):
    r = _regions(spark, d)
    found = papers.assemble_sections(r).select("paper_ref", F.col("sec_id").alias("ref"), "name", "start", "end").union(papers.assemble_tables(r))
    return found.withColumnRenamed("paper_ref", "doc_id")


@query("s_assemble_text", f"with {_REGIONS} select doc_id, string_agg(t, chr(10) order by n) as raw_text from p group by 1")
def _(spark, d):
    return papers.assemble_text(_regions(spark, d)).withColumnRenamed("paper_ref", "doc_id")


_PAPER = r"d as (select doc_id, text || chr(10) || 'Table 1. First' || chr(10) || 'Fig. 2 Second' || chr(10) || 'References' || chr(10) || '[1] one' || chr(10) || '  12. two' || chr(10) || 'no' as text from documents), l as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as s, generate_subscripts(string_split(text, chr(10)), 1) as n from d), h as (select doc_id, count(*) as k, string_agg(s, '|' order by n) as names from l where " + HEAD + r" group by 1), r as (select doc_id, string_agg(s, '|' order by n) as refs from (select *, min(case when lower(s) = 'references' then n end) over (partition by doc_id) as fst from l) where n > fst and regexp_matches(s, '^\[?\d+\]?[.\)]?\s+\w') group by 1)"


@query("s_papers", rf"with {_PAPER} select doc_id, sha1(text) as text_hash, length(text)::bigint as n_chars, greatest(1, length(text) // 4)::bigint as n_tokens, len(regexp_extract_all(text, '(?im)^\s*table\s+\d+'))::bigint as n_tables, len(regexp_extract_all(text, '(?im)^\s*(?:figure|fig\.?)\s+\d+'))::bigint as n_figures, coalesce(refs, '') as refs, coalesce(names, '') as sections, coalesce(k, 0) >= 3 as reliable from d left join h using (doc_id) left join r using (doc_id)")
def _(spark, d):
    """Every text with a table, a figure and references behind it, one of them indented."""
    tail = "\nTable 1. First\nFig. 2 Second\nReferences\n[1] one\n  12. two\nno"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_ref"), "source", F.concat("text", F.lit(tail)).alias("text"), F.lit(1).alias("n_pages"))
    named = F.array_join(F.transform(F.filter("parsed.sections", lambda s: ~s["name"].isin("body", "frontmatter")), lambda s: s["name"]), "|")
    size = lambda c: F.size(f"parsed.{c}").cast("long")
    return papers.load(docs).select(F.col("paper_ref").alias("doc_id"), "text_hash", "meta.n_chars", "meta.n_tokens", size("tables").alias("n_tables"), size("figures").alias("n_figures"), F.array_join(F.transform("parsed.refs", lambda r: r["raw"]), "|").alias("refs"), named.alias("sections"), F.col("meta.structure_reliable").alias("reliable"))


@query("s_layout", rf"with {_REGIONS.replace('documents)', 'documents where text is not null)', 1)}, kept as (select * from p where kind <> 'table') select doc_id, string_agg(t, chr(10) order by n) as raw_text from kept group by 1")
def _(spark, d):
    """Lines stand for pages, each with one region; what is long like a table is called a figure and goes."""
    pages = _regions(spark, d).where("text is not null").select("paper_ref", F.col("n").alias("page"), "category", "text")
    detect = lambda rows: rows.select("paper_ref", "page", F.lit(0).alias("ord"), F.when(F.col("category") == "table", "figure_block").when(F.col("category") == "title", "doc_title").otherwise("paragraph").alias("label"), "text")
    return papers.load_layout(pages, detect)[0].withColumnRenamed("paper_ref", "doc_id")


# anchors: words 4 to 7 of each text, up to its words 12 and 13

_WORDS = r"w as (select doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as ws from documents), r as (select doc_id, text, list_aggregate(list_transform(ws[4:7], lambda x: regexp_escape(x)), 'string_agg', '\s+') as a, list_aggregate(list_transform(ws[12:13], lambda x: regexp_escape(x)), 'string_agg', '\s+') as b from w), m as (select doc_id, text, b, regexp_extract(text, a) as hit from r), f as (select doc_id, text, instr(text, hit) - 1 as s, instr(text, hit) - 1 + length(hit) as e, b from m where hit <> ''), z as (select *, regexp_extract(text[e + 1:], b) as tail from f), spans as (select doc_id, text, s, case when coalesce(tail, '') = '' then e else e + instr(text[e + 1:], tail) - 1 + length(tail) end as e from z)"


def _spans(spark, d):
    words = F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")
    own = table(spark, d, "documents").select("doc_id", "text", words.alias("w"))
    own = own.withColumn("anchor", F.array_join(F.slice("w", 4, 4), " "))
    return own.withColumn("span", anchors.find(F.col("text"), F.col("anchor"), end_anchor=F.array_join(F.slice("w", 12, 2), " ")))


@query("t_anchor", f"with {_WORDS} select doc_id, s::int as start, e::int as \"end\" from documents left join spans using (doc_id)")
def _(spark, d):
    return _spans(spark, d).select("doc_id", "span.start", "span.end")


@query("t_verify_span", f"with {_WORDS} select doc_id, coalesce(s >= 0 and e + 40 <= length(d.text), false) as longer, s is not null as own, false as shifted from documents d left join spans using (doc_id)")
def _(spark, d):
    t, a, s, e = F.col("text"), F.col("anchor"), F.col("span.start"), F.col("span.end")
    return _spans(spark, d).select("doc_id", anchors.verify_span(t, s, e + 40, a).alias("longer"), anchors.verify_span(t, s, e, a).alias("own"), anchors.verify_span(t, e, s, a).alias("shifted"))


@query("t_window", "with w as (select doc_id, text, regexp_extract_all(text[-300:], '[А-Яа-яЁёA-Za-z0-9]{4,}')[:14] as ws from documents), p as (select doc_id, i, instr(lower(text), lower(x)) - 1 as p from (select doc_id, text, unnest(ws) as x, generate_subscripts(ws, 1) as i from w) where instr(lower(text), lower(x)) > 0), h as (select a.doc_id, a.i, any_value(a.p) as p, count(*) as n from p a join p b on a.doc_id = b.doc_id and b.p between a.p - 350 and a.p + 350 group by 1, 2), b as (select doc_id, p from (select *, row_number() over (partition by doc_id order by n desc, i) as r from h) where r = 1) select doc_id, case when p is null then text[:1200] else text[greatest(0, p - 350) + 1 : p + 350] end as w from documents left join b using (doc_id)")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", anchors.window(t, F.substring(t, F.greatest(F.lit(1), F.char_length(t) - 299), F.lit(300))).alias("w"))


# merging and verification

_PAIRS = "parts as (select distinct l_orderkey as grp, l_partkey as part from lineitem), pairs as (select a.grp, a.part as a, b.part as b from parts a join parts b on a.grp = b.grp and a.part < b.part and (a.part + b.part) % 3 = 0)"


@query("g_neardup_merge", f"with recursive {_PAIRS}, q as (select *, row_number() over (partition by grp order by a, b) as pos from pairs), st as (select distinct grp, 0::bigint as pos, []::bigint[] as gone, null::bigint as a, null::bigint as b, false as ok from q union all select q.grp, q.pos, case when list_contains(gone, q.a) or list_contains(gone, q.b) then gone else list_append(gone, q.b) end, q.a, q.b, not (list_contains(gone, q.a) or list_contains(gone, q.b)) from st join q on q.grp = st.grp and q.pos = st.pos + 1), m as (select grp, b as old, a as canon from st where ok), c as (select grp, old, canon from m union all select c.grp, c.old, m.canon from c join m on m.grp = c.grp and m.old = c.canon) select grp, old, canon from c where not exists (select 1 from m where m.grp = c.grp and m.old = c.canon)")
def _(spark, d):
    """The parts of an order stand for a paper's entities of one type; pairs whose numbers add to a multiple of 3 are the same."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("a")).distinct()
    pairs = parts.join(parts.withColumnRenamed("a", "b"), "grp").where("a < b and (a + b) % 3 = 0")
    return dedup.near_merge(pairs.withColumn("pos", F.lit(0)))


_VERDICT = "q_value / 50 as confidence, 0.7::double as clarity, (q_value % 10) / 10 as relevance"


@query("v_on_read", oracle("facts") + f", few as (select * from facts where year = 1995 and status = 'unverified' and not v_checked order by uuid limit 20), v as (select uuid, statement, q_raw, {_VERDICT} from few where q_value % 5 <> 0) select uuid, case when round((confidence + clarity + relevance) / 3, 9) >= 0.6 and relevance >= 0.4 then 'verified' else 'unverified' end as status, round((confidence + clarity + relevance) / 3, 3) as conf, repeat(statement, 20)[:400] as rationale from v")
def _(spark, d):
    f = g(spark, d, "facts")
    none = f.select("uuid", F.col("statement").alias("source")).where("false")
    asked = verify.requests(f, f.where("year = 1995").select("uuid", F.lit(0).alias("pos")), none, f.select("paper_ref", "statement").groupBy("paper_ref").agg(F.min("statement").alias("text")))
    q = F.col("q_value").cast("double")
    rule = f.where("q_value % 5 <> 0").select("uuid", (q / 50).alias("confidence"), F.lit(0.7).alias("clarity"), ((q % 10) / 10).alias("relevance"), F.repeat("statement", F.lit(20)).alias("rationale"))
    return verify.settle(asked, rule)


# answers: every fact, ranked by its year, stands for an answer's where no limit is asked for

_NAMES = "t as (select fact, type, string_agg(name, ',' order by name) as names from (select distinct fact, type, name from members) group by 1, 2), parts as (select fact, string_agg(type || ':' || names, ';' order by type) as parts from t group by 1)"


def _ranked(spark, d):
    return g(spark, d, "facts").select(F.col("uuid").alias("id"), F.col("year").alias("pos"))


def _evidence(spark, d):
    return retrieval.evidence(g(spark, d, "facts"), members(spark, d), _ranked(spark, d))


@query("r_evidence", oracle("facts", "edges", "entities") + f", {MEMBERS}, {_NAMES} select year as pos, uuid, statement, q_raw as quantity, coalesce(parts, '') as parts, paper_ref as source, year, status from facts left join parts on fact = uuid")
def _(spark, d):
    return _evidence(spark, d).withColumn("parts", said("participants")).drop("participants")


@query("r_related", oracle("facts", "edges", "entities") + f", {MEMBERS}, k as (select name, min((year, type)) as k from members join facts on fact = uuid group by 1) select name, (row_number() over (order by k, name) - 1)::int as pos from k")
def _(spark, d):
    return retrieval.related(members(spark, d), _ranked(spark, d))


@query("r_trace_nodes", oracle("facts", "edges", "entities") + f", {MEMBERS}, e as (select name, min((year, type)) as k from members join facts on fact = uuid group by 1) select 'f:' || uuid as id, 'Fact' as kind, statement[:90] as label, paper_ref as source, q_raw as value, status, year::bigint as rank from facts union all select 'e:' || name, k[2], name, null, null, null, null from e")
def _(spark, d):
    return graph.trace(_evidence(spark, d))[0]


@query("r_trace_edges", oracle("facts", "edges", "entities") + f", {MEMBERS} select distinct 'f:' || fact as src, 'e:' || name as dst from members")
def _(spark, d):
    return graph.trace(_evidence(spark, d))[1]


@query("r_mentions", "select conv_id, turn, case when turn % 2 = 0 then 'word ' || turn else text end as mention, case when turn % 2 = 0 then 'Material' end as type from conversations where text is not null and role = 'user'")
def _(spark, d):
    """A model that finds one mention in the questions of even turns and none in the others."""
    q = table(spark, d, "conversations").where("text is not null and role = 'user'")
    found = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.concat(F.lit("word "), "turn").alias("mention"), F.lit("Material").alias("type"))))
    return q.select("conv_id", "turn", F.explode(answers.mentions(F.col("text"), found)).alias("m")).select("conv_id", "turn", "m.mention", "m.type")


# Vectors of facts and entities are those of the embeddings whose number follows from their keys, so many facts share one; the vectors
# with the numbers 5, 6 and 7 ask.

_ASKED = (5, 6, 7)
_VECTORS = "emb as materialized (select vec_id, embedding::double[] as e from embeddings), nv as (select count(*) as n from emb), fv as (select uuid as id, (part * 7 + supp) % n as v, q_value from facts, nv), ev as (select uuid as id, substr(uuid, 2)::bigint % n as v from entities, nv where type <> 'Process')"


def _score(q: int) -> str:
    return f"(select vec_id as v, round(list_cosine_similarity(e, (select e from emb where vec_id = {q})), 6) as score from emb)"


def _sub_lists(k: int) -> str:
    """Each sub-question's facts after the relevance cut, and the seeds."""
    per = answers.width(k, len(_ASKED))
    lists = " union all ".join(f"select {i} as list, id, score, row_number() over (order by score desc, id) as r from fv join {_score(q)} using (v)" for i, q in enumerate(_ASKED))
    seeds = " union ".join(f"select id as node from (select id, row_number() over (order by score desc, id) as r from ev join {_score(q)} using (v)) where r <= 5" for q in _ASKED)
    return f"tops as materialized (select * from ({lists}) where r <= {per}), near as (select list, id, r - 1 as pos from (select *, max(score) over (partition by list) as best from tops) where score >= 0.85 * best or r <= 4)", seeds


def _graph(spark, d):
    e = table(spark, d, "embeddings")
    n = F.lit(e.count())
    v = e.select(F.col("vec_id").alias("v"), "embedding")
    f, x = g(spark, d, "facts"), g(spark, d, "entities")
    fv = f.select(F.col("uuid").alias("id"), ((F.col("part") * 7 + F.col("supp")) % n).alias("v")).join(v, "v").select("id", "embedding")
    ev = x.where("type <> 'Process'").select(F.col("uuid").alias("id"), (F.substring("uuid", 2, 20).cast("long") % n).alias("v")).join(v, "v").select("id", "embedding")
    return answers.Graph(f, g(spark, d, "edges"), x, fv, ev)


def _subs(spark, d):
    rows = {r.vec_id: list(r.embedding) for r in table(spark, d, "embeddings").where(F.col("vec_id").isin(*_ASKED)).collect()}  # three rows: the questions
    return [rows[q] for q in _ASKED]


def _answer_sql(k: int) -> str:
    """The order of an answer's facts (id, pos)."""
    lists, seeds = _sub_lists(k)
    n = len(_ASKED)
    walk = f"walk as (select id, row_number() over (order by score desc, id) - 1 as pos from (select node as id, round(score, 7) as score from s20 where node in (select uuid from facts)) where score > 0 qualify row_number() over (order by score desc, id) <= {max(k, 25)})"
    turns = f"ls as (select list, id, pos from near union all select {n}, id, pos from walk), one as (select id, min((pos, list)) as k from ls group by id), robin as (select id, row_number() over (order by k, id) - 1 as pos from one)"
    mixed = "num as (select robin.id, robin.pos, q_value is not null as q from robin join fv using (id)), alt as (select id, q, row_number() over (partition by q order by pos) as n from num), ranked as (select id, row_number() over (order by n, q desc) - 1 as pos from alt)"
    return f"{_VECTORS}, {lists}, {ppr_sql(BRIDGED, seeds)}, {walk}, {turns}, {mixed}, own as materialized (select id, pos from ranked where pos < {max(k, 4 * n)})"


@query("r_retrieve", oracle("edges", "entities", "facts") + f", {MEMBERS}, {_NAMES}, {_answer_sql(16)} select pos::int as pos, uuid, statement, q_raw as quantity, coalesce(parts, '') as parts, paper_ref as source, year, status from own join facts on uuid = id left join parts on fact = uuid")
def _(spark, d):
    """The flagship: three sub-questions over vectors, PageRank from their nearest entities, and the facts in turns."""
    return answers.retrieve(_graph(spark, d), _subs(spark, d))[0].withColumn("parts", said("participants")).drop("participants")


@query("r_retrieve_related", oracle("edges", "entities", "facts") + f", {MEMBERS}, {_answer_sql(16)}, k as (select name, min((pos, type)) as k from members join own on fact = id group by 1) select name, (row_number() over (order by k, name) - 1)::int as pos from k qualify row_number() over (order by k, name) <= 40")
def _(spark, d):
    return answers.retrieve(_graph(spark, d), _subs(spark, d))[1]


_TAGGED = f"{_VECTORS}, over as (select fact, count(distinct entity) as overlap from members where entity in (select entity from anchors) group by fact), {ppr_sql('select fact as a, entity as b from members', 'select entity as node from anchors')}, walk as (select node as id, row_number() over (order by round(score, 7) desc, node) - 1 as pos from s20 where node in (select uuid from facts) and round(score, 7) > 0 qualify row_number() over (order by round(score, 7) desc, node) <= 30), vec as (select id, row_number() over (order by score desc, id) - 1 as pos from fv join {_score(5)} using (v) qualify row_number() over (order by score desc, id) <= 30), tag as (select fact as id, row_number() over (order by overlap desc, fact) - 1 as pos from over), fused as (select id, sum(1.0 / (60 + pos)) as rrf from (select id, pos from walk union all select id, pos from vec union all select id, pos from tag) group by id), own as materialized (select id, row_number() over (order by coalesce(overlap, 0) desc, round(rrf, 6) desc, id) - 1 as pos from fused left join over on id = fact qualify pos < 8)"


@query("r_retrieve_overlap", oracle("edges", "entities", "facts") + f", {MEMBERS}, {ASK_SQL}, {LINKED}, {_NAMES}, {_TAGGED} select pos::int as pos, uuid, statement, q_raw as quantity, coalesce(parts, '') as parts, paper_ref as source, year, status from own join facts on uuid = id left join parts on fact = uuid")
def _(spark, d):
    """Mentions instead of sub-questions: overlap first, then tagged facts, nearest facts and PageRank fused."""
    return answers.retrieve(_graph(spark, d), _subs(spark, d)[:1], asked(spark))[0].withColumn("parts", said("participants")).drop("participants")


@query("r_rank", oracle("edges", "entities", "facts") + f", {MEMBERS}, {ASK_SQL}, {LINKED}, {_TAGGED} select id, pos::int as pos from own")
def _(spark, d):
    return answers.by_mentions(_graph(spark, d), asked(spark), _subs(spark, d)[0])


@query("s_vector_index", "select q.vec_id as query, e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q, embeddings e where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id) <= 12")
def _(spark, d):
    """Every twentieth vector against all, over an index of all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = f"{store.new_folder(spark)}/index"
    vectorindex.build(e, path, 32)
    return vectorindex.search(spark, path, e.where("id % 20 = 0"), 12).select("query", "id", F.round("score", 6).alias("score"))


_CHECKED = "ask as (select facts.*, pos from own join facts on uuid = id where status = 'unverified' and not v_checked qualify row_number() over (order by pos, uuid) <= 20), told as (select uuid, case when (q_value / 50 + 0.7 + (q_value % 10) / 10) / 3 >= 0.6 - 1e-10 and (q_value % 10) / 10 >= 0.4 then 'verified' else 'unverified' end as said from ask where q_value % 5 <> 0)"


def _answered(spark, d):
    g_ = _graph(spark, d)
    q = F.col("q_value").cast("double")
    rule = g_.facts.where("q_value % 5 <> 0").select("uuid", (q / 50).alias("confidence"), F.lit(0.7).alias("clarity"), ((q % 10) / 10).alias("relevance"), F.lit("rule").alias("rationale"))
    return answers.answer(g_, _subs(spark, d), verdicts=rule)


@query("r_answer", oracle("edges", "entities", "facts") + f", {_answer_sql(16)}, {_CHECKED} select own.pos::int as pos, f.uuid, coalesce(said, f.status) as status from own join facts f on f.uuid = id left join told on told.uuid = f.uuid")
def _(spark, d):
    """An answer's evidence after the check of facts that none was asked for."""
    return _answered(spark, d).evidence.select("pos", "uuid", "status")


@query("r_answer_requests", oracle("edges", "entities", "facts") + f", {_answer_sql(16)}, {_CHECKED} select uuid, statement, q_raw as quantity from ask")
def _(spark, d):
    return _answered(spark, d).requests.select("uuid", "statement", "quantity")


@query("r_answer_trace", oracle("edges", "entities", "facts") + f", {MEMBERS}, {_answer_sql(16)} select distinct 'f:' || fact as src, 'e:' || name as dst from members join own on fact = id")
def _(spark, d):
    return _answered(spark, d).edges


@query("r_sources", oracle("edges", "entities", "facts") + f", {_answer_sql(16)} select paper_ref, count(*) as n, min(pos)::int as first from own join facts on uuid = id group by 1")
def _(spark, d):
    return retrieval.sources(_answered(spark, d).evidence.select(F.col("source").alias("paper_ref"), "pos"))


@query("r_decompose", r"with q as (select conv_id, turn, text, list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')[:6] as subs from conversations where role = 'user' and text is not null), u as (select conv_id, turn, case when len(subs) > 0 then subs else [text] end as subs from q) select conv_id, turn, array_to_string(subs, '|') as subs from u")
def _(spark, d):
    """Sentences stand for a model's sub-questions."""
    q = table(spark, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", F.col("text").alias("question"), F.split("text", r"\.", -1).alias("subs"))
    return retrieval.decompose(q).select("conv_id", "turn", F.array_join("subs", "|").alias("subs"))


@query("d_discover", r"with p as (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, url from pages), k as (select distinct string_split(text, chr(10))[1] as title from documents) select page_id as pos, title, case page_id % 3 when 0 then 'Ada B' || page_id || ', Cy' when 1 then 'Ada B' || page_id || ', Cy, Dee E' else 'Ada B' || page_id end as authors, 2000 + page_id % 20 as year, url from p where title <> '' and not exists (select 1 from k where contains(lower(k.title), substring(lower(p.title), 1, 28)) or contains(lower(p.title), substring(lower(k.title), 1, 28))) order by page_id limit 6")
def _(spark, d):
    k, none = F.col("page_id"), F.lit(None).cast("string")
    person = lambda a, b: F.struct(a.alias("given"), b.alias("family"))
    one, two, three, four = person(F.lit("Ada"), F.concat(F.lit("B"), k)), person(none, F.lit("Cy")), person(F.lit("Dee"), F.lit("E")), person(F.lit("Too"), F.lit("Many"))
    authors = F.when(k % 3 == 0, F.array(one, person(none, none), two)).when(k % 3 == 1, F.array(one, two, three, four)).otherwise(F.array(one))
    feed = table(spark, d, "pages").select(k.alias("pos"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), authors.alias("authors"), (2000 + k % 20).alias("year"), none.alias("venue"), none.alias("doi"), "url")
    known = table(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("title")).distinct()
    return retrieval.discover(feed, known).select("pos", "title", "authors", "year", "url")


# what leaves the graph


@query("s_trace", "select event_id, to_json({'_coll': 'stage', 'event_id': event_id, 'user_id': user_id, 'event_type': event_type})::varchar as line from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.select("event_id", exports.trace_lines(e, "stage").alias("line"))


@query("s_export", oracle("edges", "entities") + ", a as (select src as node, dst as other, type from edges union all select dst, src, type from edges) select node as center, other, to_json({'id': other, 'name': canonical_name, 'group': n.type, 'edgeType': a.type})::varchar as line from a left join entities n on n.uuid = other")
def _(spark, d):
    return exports.subgraph_lines(graph.adjacency(g(spark, d, "edges")), g(spark, d, "entities"))


@query("s_export_md", oracle("edges", "entities", "facts") + f", {_answer_sql(16)}, o as (select facts.*, pos from own join facts on uuid = id), f as (select count(*) as k, coalesce(string_agg('- ' || statement || ' (**' || q_raw || '**) — _' || paper_ref || '_ [' || status || ']' || chr(10), '' order by pos), '') as facts from o), s as (select coalesce(string_agg('- ' || paper_ref || ' (' || n || ' фактов)', chr(10) order by n desc, paper_ref), '') as files from (select paper_ref, count(*) as n from o group by 1)) select '# Ответ на запрос' || chr(10) || chr(10) || '**Вопрос:** Which parts?' || chr(10) || chr(10) || 'These.' || chr(10) || chr(10) || '## Факты (' || k || ')' || chr(10) || facts || chr(10) || '## Файлы-источники' || chr(10) || files || chr(10) as md from f, s")
def _(spark, d):
    """The flagship's answer."""
    e = answers.retrieve(_graph(spark, d), _subs(spark, d))[0]
    return exports.answer_markdown("Which parts?", "These.", e, retrieval.sources(e.select(F.col("source").alias("paper_ref"), "pos")))
