"""Quality rules: fixed base rules, then robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import columns, scratch
from factloom.llm.columns import let

#: Rows that a (language, source) group needs for an estimate of its own; below it, its language's or all rows' holds.
LEAST_ROWS = 200
#: The part of a group's rows that the estimate rests on, and the concentration steps.
PART, STEPS = 0.75, 4
#: Fixed values for 4 statistics: the factor that makes a 75 % subset's covariance consistent for a normal distribution
#: (PART / P(chi2_6 <= q), q the 75 % point of chi2_4), and the 1 - 1e-6 point of chi2_4 as the cut.
CONSISTENT, CUT = 1.49, 33.4
#: Statistics in a vector, the units of its integers, and the rows up to which a table with a row for each key (200 bytes) is broadcast.
P, UNIT, KEYS = 4, 10_000, 100_000


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more. The windows are compared as texts; only a text that has
    equal ones is sorted, and the starts of its repeated windows in order then tell how many words they cover."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<string>"))

    def starts(s: Column) -> Column:
        same = lambda a, j: F.coalesce(F.get(s, j)["w"] == a["w"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda a, j: F.when(same(a, j + 1) | ((j > 0) & same(a, F.greatest(j - 1, F.lit(0)))), a["i"])), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, begin, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(starts(s), covered)))

    return let(windows, count)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text (null: all 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(columns.WORD))
    return docs.select(
        *keep,
        columns.n_words(text).alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(columns.SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(columns.words(text), _repeat_words).alias("n_repeat_words"),
    )


def _vector() -> list[Column]:
    """The transformed statistics as integers, in units of 1/UNIT: sums over them do not depend on the order of rows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = [F.log((F.col("word_chars") + 1) / n), F.log1p(20 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(x)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the lower triangle l{i}{j} of the covariance: forward substitution."""
    z: list[Column] = []
    for i in range(P):
        z.append(reduce(lambda a, j: a - F.col(f"l{i}{j}") * z[j], range(i), F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _floors() -> list[Column]:
    """Each statistic's resolution: what one character, symbol, line or window more does to a text of the median length.

    The least standard deviation. It counts only where the estimate lies below it: a statistic that is constant in a
    group (most texts hold no symbol) would else reject any other value.
    """
    n = F.greatest(F.col("length"), F.lit(1)).cast("double")
    f = [1 / (F.exp("m0") * n), F.log1p(20 / n), F.log1p(100 / n), 3 / n]
    return [F.greatest(v, F.lit(1 / UNIT)).alias(f"f{i}") for i, v in enumerate(f)]


def _triangle(moments: DataFrame, floors: DataFrame) -> DataFrame:
    """From n, s{i} (sums) and q{i}{j} (sums of products): means, the covariance's triangle, log determinant."""
    n = F.col("n").cast("double")
    d = moments.join(floors, "key").select("key", "start", "n", *[f"f{i}" for i in range(P)], *[(F.col(f"s{i}").cast("double") / n / UNIT).alias(f"m{i}") for i in range(P)], *[(F.col(f"q{i}{j}").cast("double") / n / UNIT**2).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            s = F.lit(CONSISTENT) * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
            least = F.col(f"f{i}") * F.col(f"f{i}")
            s = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.greatest(s, least) if i == j else s)
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, least / 100)) if i == j else s / F.col(f"l{j}{j}"))
    return d.select("key", "start", "n", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(P)]).alias("logdet"))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "start").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(P)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)],
    )


def _rank_bin(counts: DataFrame, by: list[str], part: float) -> DataFrame:
    """The least bin of each group up to which at least `part` of its rows lie; counts: `by`, bin, n."""
    up = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    whole = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("up", up).withColumn("whole", whole).where(F.col("up") >= F.ceil(F.col("whole") * part)).groupBy(*by).agg(F.min("bin").alias("top"))


def estimates(rows: DataFrame) -> DataFrame:
    """For every key of rows (key, n_words, x0..), its robust estimate: the better, by log determinant, of two starts.

    One start is all rows; the other the coordinates' medians with the least deviations. A concentration step takes the
    PART of a key's rows with the smallest distances (whole bins of 1/16 of a power of two, so ties stay together) and
    estimates anew. Bins, sums and their triangle are small tables with a row for each key; the rows are never gathered.
    """
    dims = rows.select("key", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(P)], 100 * F.col("n_words"))).alias("dim", "x")).withColumn("bin", F.floor(F.col("x") / 100))
    medians = _rank_bin(dims.groupBy("key", "dim", "bin").agg(F.count(F.lit(1)).alias("n")), ["key", "dim"], 0.5)
    middle = medians.groupBy("key").agg(*[F.max(F.when(F.col("dim") == i, (F.col("top") + 0.5) / 100)).alias(f"m{i}") for i in range(P)], F.max(F.when(F.col("dim") == P, F.col("top"))).alias("length"))
    middle = scratch.small(middle.select("key", *[f"m{i}" for i in range(P)], *_floors()), "quality-middle", KEYS)
    floors = middle.select("key", *[f"f{i}" for i in range(P)])
    middle = middle.select("key", F.lit(1).alias("start"), F.lit(0).cast("long").alias("n"), *[f"m{i}" for i in range(P)], *[(F.col(f"f{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)], F.lit(0.0).alias("logdet"))
    now = scratch.small(_triangle(_moments(rows.withColumn("start", F.lit(0))), floors).unionByName(middle), "quality-start", KEYS)
    for k in range(STEPS):
        at = rows.join(now, "key").select("key", "start", *[f"x{i}" for i in range(P)], F.floor(16 * F.log2(1 + _distance())).alias("bin"))
        tops = scratch.small(_rank_bin(at.groupBy("key", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["key", "start"], PART), f"quality-top-{k}", KEYS)
        now = scratch.small(_triangle(_moments(at.join(tops, ["key", "start"]).where("bin <= top")), floors), f"quality-step-{k}", KEYS)
    best = Window.partitionBy("key").orderBy("logdet", "start")
    return scratch.small(now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start", "n", "logdet"), "quality-estimates", KEYS)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null if base_failed), kept; one row for each row of docs.

    base_failed: under 50 words, or over half of the words in repeated windows. The rest is kept unless its squared
    distance from its group passes the CUT. Groups are (lang, source), null a value of its own; those with fewer than
    LEAST_ROWS rows that pass the base rules take their language's estimate, or, where that has too few as well, that of
    all rows; with fewer rows in all, that one all the same. Equal rows get equal verdicts, whatever
    their ids; a null doc_id stays null. Texts of any length are read whole. Columns beside doc_id, text, lang and source are
    ignored; an empty table gives no row.
    """
    keep = keep or []
    stats = statistics(docs, ["doc_id", "lang", "source", *keep])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = scratch.stage(stats.select("doc_id", *keep, columns.key_of(F.col("lang"), F.col("source")).alias("own"), columns.key_of(F.col("lang")).alias("tongue"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *_vector()), "quality-rows")
    keys = rows.where("not base_failed").select(F.explode(F.array("own", "tongue", F.lit("all"))).alias("key"), "n_words", *[f"x{i}" for i in range(P)])
    found = estimates(keys)
    counts = rows.groupBy("own", "tongue").agg(F.count_if(~F.col("base_failed")).alias("n"))
    counts = counts.withColumn("n_tongue", F.sum("n").over(Window.partitionBy("tongue")))
    chosen = scratch.small(counts.select(F.col("own").alias("o"), F.when(F.col("n") >= LEAST_ROWS, F.col("own")).when(F.col("n_tongue") >= LEAST_ROWS, F.col("tongue")).otherwise(F.lit("all")).alias("key")), "quality-groups", KEYS)
    told = rows.join(chosen, F.col("own") == F.col("o")).join(found, "key", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return told.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & (distance <= CUT)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns, whatever their names. Rows that repeat stay or go together; a null
    doc_id, lang or source is a value like any other."""
    marked = docs.select("doc_id", "text", "lang", "source", F.xxhash64(*docs.columns).alias("_h"), F.struct(*docs.columns).alias("_row"))
    good = judge(marked, ["_h"]).where("kept").select("doc_id", "_h").distinct()
    kept = marked.join(good.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left_semi")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _triangle_sql(source: str) -> str:
    """The triangle of moments (n, s.., q..) joined to floors (f..): each column may name those before it."""
    out = [f"s{i}::double / n / {UNIT} as m{i}" for i in range(P)]
    for i in range(P):
        for j in range(i + 1):
            cov = f"{CONSISTENT} * (q{i}{j}::double / n / {UNIT**2} - m{i} * m{j})"
            less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt(greatest(greatest({cov}, f{i} * f{i}){less}, f{i} * f{i} / 100)) as l{i}{j}" if i == j else f"({cov}{less}) / l{j}{j} as l{i}{j}")
    names = ", ".join([*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]])
    return f"select key, start, {names}, {' + '.join(f'ln(l{i}{i})' for i in range(P))} as logdet from (select key, start, {', '.join(out)} from {source} join (select key, {', '.join(f'f{i}' for i in range(P))} from floors) using (key))"


def _distance_sql() -> str:
    z: list[str] = []
    for i in range(P):
        z.append(f"((x{i} / {float(UNIT)} - m{i}" + "".join(f" - l{i}{j} * {z[j]}" for j in range(i)) + f") / l{i}{i})")
    return " + ".join(f"{v} * {v}" for v in z)


def _sql() -> str:
    """Statistics, the three keys of every row, medians, two starts and the concentration steps, as in `estimates` and `judge`."""
    xs = [f"x{i}" for i in range(P)]
    moments = "select key, start, count(*) as n, " + ", ".join([*[f"sum({x}) as s{i}" for i, x in enumerate(xs)], *[f"sum({xs[i]} * {xs[j]}) as q{i}{j}" for i in range(P) for j in range(i + 1)]]) + " from {} group by key, start"
    middle = "select key, 1 as start, " + ", ".join([*[f"m{i}" for i in range(P)], *[f"f{i} as l{i}{j}" if i == j else f"0.0::double as l{i}{j}" for i in range(P) for j in range(i + 1)]]) + ", 0.0::double as logdet from floors"
    steps = [f"n0 as materialized ({_triangle_sql('(' + moments.format('(select *, 0 as start from rows)') + ')')} union all {middle})"]
    for k in range(STEPS):
        steps.append(f"at{k} as materialized (select key, start, {', '.join(xs)}, floor(16 * log2(1 + {_distance_sql()})) as bin from rows join n{k} using (key))")
        steps.append(f"b{k} as (select key, start, bin, sum(count(*)) over (partition by key, start order by bin) as up, sum(count(*)) over (partition by key, start) as whole from at{k} group by key, start, bin)")
        steps.append(f"top{k} as (select key, start, min(bin) as top from b{k} where up >= ceil(whole * {PART}) group by key, start)")
        steps.append(f"n{k + 1} as materialized ({_triangle_sql('(' + moments.format(f'(select a.* from at{k} a join top{k} t on a.key = t.key and a.start = t.start where bin <= top)') + ')')})")
    n = "greatest(n_words, 1)::double"
    vector = [f"ln((word_chars + 1) / {n})", f"ln(1 + 20 * n_symbols / {n})", f"ln(1 + 100 * n_dup_lines / {n})", f"n_repeat_words / {n}"]
    m = [f"(max(top) filter (where dim = {i}) + 0.5::double) / 100" for i in range(P)]
    floors = ["1 / (exp(m0) * n)", "ln(1 + 20 / n)", "ln(1 + 100 / n)", "3 / n"]
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
w as (select doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as win from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from t)),
r as (select doc_id, count(distinct p + k) as n_repeat_words from (select doc_id, p from w qualify count(*) over (partition by doc_id, win) > 1), range(3) r(k) group by doc_id),
st as (select t.doc_id, coalesce(lang, chr(1)) as tongue, coalesce(lang, chr(1)) || chr(2) || coalesce(source, chr(1)) as own, len(ws) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from t left join r using (doc_id)),
j as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"round({v} * {UNIT})::bigint as x{i}" for i, v in enumerate(vector))} from st),
rows as materialized (select unnest([own, tongue, 'all']) as key, n_words, {", ".join(xs)} from j where not base_failed),
dims as (select key, unnest(range({P + 1})) as dim, unnest([{", ".join(f"floor(x{i} / 100)" for i in range(P))}, n_words]) as bin from rows),
c as (select key, dim, bin, sum(count(*)) over (partition by key, dim order by bin) as up, sum(count(*)) over (partition by key, dim) as whole from dims group by key, dim, bin),
med as (select key, {", ".join(f"{v} as m{i}" for i, v in enumerate(m))}, greatest(max(top) filter (where dim = {P}), 1)::double as n from (select key, dim, min(bin) as top from c where up >= ceil(whole * 0.5) group by key, dim) group by key),
floors as materialized (select key, {", ".join(f"m{i}" for i in range(P))}, {", ".join(f"greatest({v}, {1 / UNIT}) as f{i}" for i, v in enumerate(floors))} from med),
{", ".join(steps)},
best as (select * from n{STEPS} qualify row_number() over (partition by key order by logdet, start) = 1),
g as (select own, tongue, count(*) filter (where not base_failed) as n from j group by own, tongue),
h as (select own, case when n >= {LEAST_ROWS} then own when sum(n) over (partition by tongue) >= {LEAST_ROWS} then tongue else 'all' end as key from g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, case when base_failed then false else {_distance_sql()} <= {CUT} end as kept
from j join h using (own) left join best using (key)
"""


ORACLE = _sql()
#: `keep_good` over documents
APPLY_SQL = f"select doc_id, text, lang, source from documents where doc_id in (select doc_id from ({ORACLE}) where kept)"
