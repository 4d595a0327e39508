"""The fact graph as views over the relational tables. The SQL runs in Spark and in the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom import vocab

_ID = "sha1(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string), cast(cast(l_quantity as int) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(round(l_discount * 100) as int) as string), cast(cast(round(l_tax * 100) as int) as string), l_returnflag, l_linestatus, cast(cast(l_shipdate as date) as string)))"

VIEWS = {
    "facts": f"""
select {_ID} as uuid,
  case when l_returnflag = 'A' then 'MaterialMeasurement' when l_returnflag = 'R' then 'SynthesisProcedure' when l_linestatus = 'O' then 'ClaimFact' else 'HypothesisFact' end as frame_type,
  cast(l_orderkey as string) as paper_ref, case when l_linenumber = 3 then 'table' else 'text' end as source,
  concat('Order ', cast(l_orderkey as string), ' took ', cast(cast(l_quantity as int) as string), ' of part ', cast(l_partkey as string)) as statement,
  l_quantity as q_value, 'unit' as q_unit, '=' as q_operator, concat(cast(cast(l_quantity as int) as string), ' unit') as q_raw,
  case when l_linenumber = 1 then 'contested' when l_linenumber = 2 then 'verified' else 'unverified' end as status,
  cast(year(l_shipdate) as int) as year, l_linenumber % 2 = 0 as v_checked, l_partkey as part, l_suppkey as supp
from lineitem""",
    "entities": """
select concat('m', cast(p_partkey as string)) as uuid, 'Material' as type, p_name as canonical_name, concat('Material:', replace(p_name, ' ', '-')) as entity_key from part
union all select concat('f', cast(s_suppkey as string)), 'Facility', s_name, concat('Facility:', lower(s_name)) from supplier
union all select concat('l', cast(n_nationkey as string)), 'Location', n_name, concat('Location:', lower(n_name)) from nation
union all select distinct concat('p:', p_type), 'Process', p_type, concat('Process:', lower(p_type)) from part""",
    "edges": f"""
select {_ID} as src, concat('m', cast(l_partkey as string)) as dst, 'HAS_MATERIAL' as type from lineitem
union all select {_ID}, concat('f', cast(l_suppkey as string)), 'CONDUCTED_BY' from lineitem
union all select {_ID}, concat('l', cast(s_nationkey as string)), 'LOCATED_IN' from lineitem join supplier on l_suppkey = s_suppkey
union all select {_ID}, concat('p:', p_type), 'VIA_PROCESS' from lineitem join part on l_partkey = p_partkey
union all select concat('f', cast(s_suppkey as string)), concat('l', cast(s_nationkey as string)), 'AFFILIATED_WITH' from supplier""",
    "frames": f"""
select {_ID} as chunk, '0' as ord, cast(l_orderkey as string) as paper_ref,
  case when l_linenumber = 1 then 'Rumour' when l_returnflag = 'A' then 'MaterialMeasurement' when l_returnflag = 'R' then 'SynthesisProcedure' else 'HypothesisFact' end as frame_type,
  concat('Part  ', cast(l_partkey as string)) as material, case when l_linenumber % 2 = 0 then ' ' else concat('Process ', l_linestatus) end as process,
  case when l_suppkey % 3 <> 0 then concat('Place ', cast(l_suppkey as string)) end as location,
  concat('Maker ', cast(l_suppkey as string)) as mention, case when l_suppkey % 2 = 0 then 'Person' else 'Mood' end as mention_type,
  case when l_linenumber <> 3 then concat('Line ', cast(l_linenumber as string)) end as statement, case when l_linenumber <> 3 then l_linenumber = 4 end as negated
from lineitem""",
    # the explorer's graph
    "xnodes": f"""
select concat('m', cast(p_partkey as string)) as node, 'Material' as kind, p_name as label, case when p_partkey % 3 = 0 then p_name end as name, cast(null as string) as statement, case p_partkey % 5 when 0 then 'RU' when 1 then 'world' when 2 then 'RU+world' when 3 then '' end as geography,
  concat('pub_', substr('abcdefgh', cast(p_partkey % 8 as int) + 1, 1), cast(p_partkey as string)) as source, false as is_gap, case when p_partkey % 2 = 0 then cast(p_size as double) end as low, case when p_partkey % 2 = 0 then cast(p_size + 9 as double) end as high, cast(p_size as double) as value from part
union all select distinct concat('p:', p_type), 'Process', p_type, cast(null as string), cast(null as string), 'RU', '', false, cast(null as double), cast(null as double), cast(null as double) from part
union all select distinct concat('c:', o_orderpriority), 'Condition', o_orderpriority, cast(null as string), cast(null as string), '', '', false, cast(null as double), cast(null as double), cast(null as double) from orders
union all select concat('f', cast(s_suppkey as string)), 'Facility', s_name, s_name, cast(null as string), 'world', cast(null as string), false, cast(null as double), cast(null as double), s_acctbal from supplier
union all select concat('x', cast(c_custkey as string)), 'Expert', c_name, c_name, cast(null as string), cast(null as string), '', false, cast(null as double), cast(null as double), cast(null as double) from customer
union all select concat('pub_', substr('abcdefgh', cast(doc_id % 8 as int) + 1, 1), cast(doc_id as string)), 'Publication', source, source, cast(null as string), '', '', false, cast(null as double), cast(null as double), cast(null as double) from documents
union all select {_ID}, 'Finding', '', cast(null as string), concat('Order ', cast(l_orderkey as string), ' took ', cast(cast(l_quantity as int) as string), ' of part ', cast(l_partkey as string)), case when l_linenumber = 1 then 'RU' when l_linenumber = 2 then 'world' end, '', l_linenumber = 7, cast(null as double), cast(null as double), l_quantity from lineitem""",
    "xedges": f"""
select {_ID} as src, concat('m', cast(l_partkey as string)) as dst, 'USES_MATERIAL' as type from lineitem
union all select {_ID}, concat('p:', p_type), 'APPLIES_TO' from lineitem join part on l_partkey = p_partkey
union all select {_ID}, concat('c:', o_orderpriority), 'OPERATES_AT_CONDITION' from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 1
union all select {_ID}, concat('pub_', substr('abcdefgh', cast(doc_id % 8 as int) + 1, 1), cast(doc_id as string)), 'DESCRIBED_IN' from lineitem join documents on l_orderkey = doc_id
union all select concat('m', cast(p_partkey as string)), concat('c:', o_orderpriority), 'OPERATES_AT_CONDITION' from part join (select min(o_orderpriority) as o_orderpriority from orders) on p_partkey % 50 = 1
union all select concat('pub_', substr('abcdefgh', cast(doc_id % 8 as int) + 1, 1), cast(doc_id as string)), concat('x', cast(doc_id % 97 + 1 as string)), 'AUTHORED_BY' from documents
union all select concat('x', cast(c_custkey as string)), concat('f', cast(c_custkey % 10 + 1 as string)), 'WORKS_AT' from customer where c_custkey % 3 = 0
union all select concat('m', cast(p_partkey as string)), concat('m', cast(p_partkey + 1 as string)), 'CONTRADICTS' from part where p_partkey % 10 = 4""",
}


#: whether a trimmed line s is a heading, in the oracle's SQL
HEAD = r"case when length(s) > 0 and length(s) <= 80 and len(string_split(regexp_replace(s, '\s+', ' ', 'g'), ' ')) <= 12 and (regexp_matches(s, '^\d+(\.\d+)*\.?\s+\S') or (upper(s) = s and lower(s) <> s and len(string_split(regexp_replace(s, '\s+', ' ', 'g'), ' ')) <= 8) or rtrim(lower(trim(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '(?i)^(?:[ivxlcdm]+|\d+(?:\.\d+)*|[a-z])[.)]?\s+', ''))), ':') in (" + ", ".join(f"'{k}'" for k, _ in vocab.SECTION_PRIORS) + ")) then true else false end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; its tables are read from the folder."""
    sql, tables = VIEWS[name], {}
    for t in ("lineitem", "supplier", "nation", "part", "orders", "customer", "documents"):
        if f" {t}" in sql:
            tables[t] = table(spark, sf_dir, t)
            for word in ("from", "join"):
                sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(sql, **tables)


def oracle(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + "\n"
