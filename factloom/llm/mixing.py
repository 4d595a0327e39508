"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import columns, prefix, scratch

BLOCKS, SHARDS, SEED = 2**20, 8, 20240611


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Adds `target` to (source, size, weight): share * all sizes by weight; what goes beyond most * size is shared again by weight.

    A row a source. The resharing ends where target = min(weight * level, most * size) for one level; sorted by
    most * size / weight, the level follows from sums over the sources that are stopped and those that are not.
    """
    d = sizes.withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "source")
    down = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(down)
    d = d.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole))
    return d.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("ratio", "level")


def sainte_lague(votes: DataFrame, key: str, value: str, houses: DataFrame) -> DataFrame:
    """(house, key, seats) for every house size in `houses` (house long, seats_in_all long): the highest quotients value / (2 k + 1).

    With V all votes, n seats and S keys, rounding value * (n - S) / V gives each key at most what it gets, and rounding
    value * (n + S) / V at least that; only quotients between are made and ranked, 3 S at most for each house. Equal
    quotients: the smaller key first. Keys without votes get no seat.
    """
    some = votes.where(F.col(value) > 0).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    total = some.agg(F.sum("v").alias("all_v"), F.count(F.lit(1)).alias("n_keys"))
    both = some.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(houses))  # one row, and a row a shard
    seats = lambda n: F.greatest(F.lit(0), F.floor(F.col("v") * n / F.col("all_v") + 0.5)).cast("long")
    low = F.greatest(F.lit(0).cast("long"), seats(F.col("seats_in_all") - F.col("n_keys")) - 1)
    both = both.withColumn("low", low).withColumn("high", seats(F.col("seats_in_all") + F.col("n_keys")) + 1)
    open_seats = F.col("seats_in_all") - F.sum("low").over(Window.partitionBy("house"))
    tried = both.withColumn("open", open_seats).withColumn("k", F.explode(F.sequence(F.col("low"), F.col("high"))))
    rank = F.row_number().over(Window.partitionBy("house").orderBy((F.col("v") / (2 * F.col("k") + 1)).desc(), F.col("key")))
    won = tried.withColumn("rank", rank).groupBy("house", "key").agg((F.first("low") + F.sum(F.when(F.col("rank") <= F.col("open"), 1).otherwise(0))).cast("long").alias("seats"))
    return won


def quotas(sizes: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(source, shard, quota, block): integer quotas of blocks of `block` tokens for each source and shard.

    Sainte-Laguë never takes a seat back as the house grows, so a shard's quotas are what the house gains between the
    shard's first block and the next shard's: every shard holds the sources in the target's proportions.
    """
    spark = sizes.sparkSession
    whole = sizes.agg(F.greatest(F.lit(1), F.floor(F.sum("target") / blocks)).cast("long").alias("block"), F.sum("target").alias("all_target"))
    houses = spark.range(1, shards + 1).select(F.col("id").alias("house")).crossJoin(F.broadcast(whole)).withColumn("seats_in_all", F.floor(F.round(F.col("all_target") / F.col("block")) * F.col("house") / F.lit(shards)).cast("long"))
    got = sainte_lague(sizes, "source", "target", houses.select("house", "seats_in_all"))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("key").orderBy("house"))
    return got.select(F.col("key").alias("source"), (F.col("house") - 1).cast("int").alias("shard"), (F.col("seats") - before).alias("quota")).crossJoin(F.broadcast(whole.select("block")))


def mix(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: int = 2, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """_id, _size, _source_size, _target, _taken, _row (a struct of the columns `carry`, whatever their names), and what is taken in
    words of the document from 0: _parts (shard, from, to) for each shard that takes some, and _takes (from, to) for each time.

    Size: words of the text (null: 0). Sources in the order of code points, null (a source of its own) last, weigh
    `weights`, repeating. Each source's documents lie end to end in a seeded order, cut into blocks of equal tokens, and the
    blocks form a ring. From a seeded block on, the shards take their quotas one after the other: shard 0 its quota of blocks,
    shard 1 the blocks behind them, round the ring as often as it takes. So no document exceeds `most` times its size, a
    source's words come within two blocks of its target, and a shard's within two blocks of its share; a block is the
    `blocks`th part of the mix. Sources without words have target 0. Rows of one id are placed by their text too; equal rows
    each have a place of their own and are interchangeable. No documents: no rows. A row a source is all that meets in one task.
    """
    weights = weights or [3, 1, 2]
    h = columns.order_key(seed, F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256))
    row = F.struct(*(carry or [F.lit(None).cast("int").alias("none")]))
    sized = scratch.stage(docs.select(F.col("doc_id").alias("id"), columns.source_key(F.col("source")).alias("source"), columns.n_words(F.col("text")).alias("size"), h.alias("h"), row.alias("row")), "mixing-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("size"))
    place = F.row_number().over(Window.orderBy("source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    per = scratch.stage(targets(per, share, most), "mixing-targets")
    lists = scratch.stage(quotas(per, shards, blocks), "mixing-quotas").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "quota"))).alias("quotas"), F.first("block").alias("block"))  # `shards` entries a source
    plan = per.join(lists, "source", "left").select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "quotas", F.coalesce("block", F.lit(1)).alias("block"))
    plan = plan.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long"))
    off = F.pmod(columns.order_key(seed, F.col("s")), F.col("n"))
    blocks_before = lambda k: F.least(most * F.col("n"), F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), F.lit(0).cast("long"), lambda a, i: a + F.when(i < k, F.coalesce(F.try_element_at("quotas", i), F.lit(0))).otherwise(0)))
    # block b of the unrolled ring starts at this word of the source, laid end to end as often as the ring is passed
    word = lambda b: F.floor(b / F.col("n")) * F.col("source_size") + (b % F.col("n")) * F.col("block")
    plan = plan.withColumn("cuts", F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda k: word(off + blocks_before(k)).cast("long")))
    plan = scratch.small(plan.select("s", "source_size", "target", "cuts"), "mixing-plan")
    laid = prefix.running(sized, "source", ["h", "id", "size"], "size", prefix.pieces(sized.count()))
    at = laid.join(plan, F.col("source") == F.col("s"))
    turns = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.col("start") + k * F.col("source_size"))
    inside = lambda x, t: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), x - t))
    some = lambda xs: F.filter(xs, lambda x: x["to"] > x["from"])
    cut = lambda k: F.get("cuts", k)
    takes = some(F.transform(turns, lambda t: F.struct(inside(cut(F.lit(0)), t).alias("from"), inside(cut(F.lit(shards)), t).alias("to"))))
    parts = F.flatten(F.transform(turns, lambda t: some(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(k.alias("shard"), inside(cut(k), t).alias("from"), inside(cut(k + 1), t).alias("to"))))))
    at = at.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return at.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").cast("double").alias("_target"), taken.alias("_taken"), F.col("row").alias("_row"), parts.alias("_parts"), F.col("takes").alias("_takes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: weights 3, 1, 2 over the sources, 150 % of all words, at most twice each; shards (a further column) tells
    which of the 8 shards take a part, in order."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("_parts", lambda p: p["shard"]))), ",")
    return got.select(F.col("_id").alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")], shards.alias("shards"))


def apply(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """The mixed documents with docs' columns: a row for each time that a document is taken whole, with the text as it was, and a
    row with the words taken where it is taken in part; n_chars follows the text. Documents that the mix does not take go; of
    a row that repeats each copy follows its own plan."""
    takes = mix(docs, seed=seed, carry=docs.columns, **parameters).select("_row", "_size", F.explode("_takes").alias("_take"))
    lo, hi, text = F.col("_take.from"), F.col("_take.to"), F.col("_row")["text"]
    cut = F.array_join(F.slice(columns.words(text), (lo + 1).cast("int"), (hi - lo).cast("int")), " ")
    new = {"text": F.when((lo == 0) & (hi == F.col("_size")), text).otherwise(cut)}
    out = takes.withColumn("_text", new["text"])
    own = lambda c: F.col("_text") if c == "text" else F.char_length("_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("_row")[c]
    return out.select(*[own(c).alias(c) for c in docs.columns])


def _sql() -> str:
    """Targets by one level for all sources, found among the levels of each; seats of all houses by quotients; then the ring: a
    document lies at `start` in each of three turns, and the cuts between the shards' quotas follow from the seats."""
    key = columns.order_key_sql
    return f"""
with d as (select doc_id, coalesce('0' || source, '1') as s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, {key(SEED, "doc_id", "sha256(coalesce(text, ''))")} as h from documents),
per as (select s, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by s) - 1) % 3 + 1)::int]::double as weight from d group by s),
o as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from per),
l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by ratio, s rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, s rows between current row and unbounded following) as level from o),
t as materialized (select s, source_size, weight, least(cap, coalesce(weight * (select arg_min(level, (ratio, s)) from l where level <= ratio), cap)) as target from l),
w as materialized (select greatest(1, floor(sum(target) / {BLOCKS}))::bigint as block, sum(target) as total from t),
ho as (select k as house, floor(round(total / block) * k / {SHARDS})::bigint as seats from range(1, {SHARDS + 1}) r(k), w),
v as (select house, seats, s, target, total, count(*) over (partition by house) as keys from ho, t, w where target > 0),
r as (select *, greatest(0, greatest(0, floor(target * (seats - keys) / total + 0.5))::bigint - 1) as low, greatest(0, floor(target * (seats + keys) / total + 0.5))::bigint + 1 as high from v),
q as (select *, seats - sum(low) over (partition by house) as open from r),
e as (select house, s, low, open, row_number() over (partition by house order by target / (2 * k + 1) desc, s) as rank from (select *, unnest(range(low, high + 1)) as k from q)),
won as (select house, s, (any_value(low) + count(*) filter (where rank <= open))::bigint as seats from e group by 1, 2),
n as (select s, source_size, target, block, greatest(1, ceil(source_size / block))::bigint as n from t, w),
f as (select *, ((({key(SEED, "s")} - (1::bigint << 59)) * 16) % n + n) % n as off from n),
b as (select f.*, k, least(2 * n, coalesce((select seats from won where won.s = f.s and house = k), 0)) as got from f, range({SHARDS + 1}) r(k)),
c as (select *, ((off + got) // n) * source_size + ((off + got) % n) * block as cut from b),
cuts as (select s, any_value(source_size) as source_size, any_value(target) as target, list(cut order by k) as cuts from c group by s),
p as (select doc_id, s, size, coalesce(sum(size) over (partition by s order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d),
x as (select doc_id, size, source_size, target, cuts, start + turn * source_size as start from p join cuts using (s), range(3) r(turn))
"""


ORACLE = f"""
{_sql()},
y as (select *, k, greatest(0, least(size, cuts[k + 2] - start) - greatest(0, cuts[k + 1] - start)) as part from x, range({SHARDS}) r(k))
select doc_id, size, source_size, target, sum(part)::bigint as taken, coalesce(string_agg(distinct k::varchar, ',' order by k::varchar) filter (where part > 0), '') as shards from y group by all
"""
#: `apply` over documents
APPLY_SQL = f"""
{_sql()}, z as (select doc_id, size, greatest(0, least(size, cuts[1] - start)) as lo, greatest(0, least(size, cuts[{SHARDS + 1}] - start)) as hi from x)
select doc_id, case when lo = 0 and hi = size then text else array_to_string((regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))[lo + 1 : hi], ' ') end as text, lang, source from z join documents using (doc_id) where hi > lo
"""
