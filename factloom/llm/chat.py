r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, in regular expressions over code points:

    conversation := turn*
    turn         := "[INST]" role "\n" text "[/INST]"   (any role but assistant)
                  | "<s>" text "</s>"                    (assistant; the text is under the loss mask)

A control string is one of [INST] [/INST] <s> </s>. Inside a text a bare one is an error of the grammar. Escaping adds a
tilde behind the bracket of every control string and of every string that already looks escaped (<s> to <~s>, <~s> to <~~s>);
reading takes one away. In roles, a line feed and a backslash are written with a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm.columns import let

#: Fixed: the control strings, as one pattern each for a bare one, one that may be escaped, and one that is.
BARE = r"\[/?INST\]|</?s>"
ANY = r"(\[)(~*/?INST\])|(<)(~*/?s>)"
ESCAPED = r"(\[)~(~*/?INST\])|(<)~(~*/?s>)"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[(~*/?INST\])", r"[~$1"), r"<(~*/?s>)", r"<~$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[~(~*/?INST\])", r"[$1"), r"<~(~*/?s>)", r"<$1")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    """One pass from the left: at a written backslash the role is cut, and between the cuts backslash n is a line feed."""
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    """One turn; text is escaped already or needs no escape."""
    return F.when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), _role(role), F.lit("\n"), text, F.lit("[/INST]")))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null if it does not follow the grammar."""

    def turn(t: Column) -> Column:
        own = F.startswith(t, F.lit("<s>"))
        inside = F.when(own, F.substring(t, F.lit(4), F.char_length(t) - 7)).otherwise(F.substring(t, F.lit(7), F.char_length(t) - 13))
        cut = F.instr(inside, "\n")
        role = F.when(own, F.lit("assistant")).otherwise(_unrole(F.substring(inside, F.lit(1), cut - 1)))
        text = F.when(own, inside).otherwise(F.substring(inside, cut + 1, F.char_length(inside)))
        good = ~inside.rlike(BARE) & (own | (cut > 0))
        return F.struct(role.alias("role"), F.when(good, unescape(text)).alias("text"))

    def checked(pieces: Column) -> Column:
        turns = F.transform(pieces, turn)
        return F.when(F.array_join(pieces, "") == formatted, let(turns, lambda ts: F.when(~F.exists(ts, lambda t: t["text"].isNull()), ts)))

    return let(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), checked)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of first code point from 0 and length of each assistant text in `formatted`).

    Turns follow by turn, null first, then role and text. A null role or text is an empty one; so is its reading. Every
    turn is rendered bare and reparsed; where the reading differs from the source it is escaped. The whole is reparsed
    again and must give the source, or the query fails. A conversation is one row, as long as its turns; rows with a null
    conv_id are one conversation, and turns that repeat are as many turns. Roles and texts may hold anything. Extra columns are
    ignored; an empty table gives no row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    alone = parse(render(role, text))
    same = F.coalesce((F.size(alone) == 1) & (F.get(alone, F.lit(0))["text"] == text), F.lit(False))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), render(role, F.when(same, text).otherwise(escape(text))).alias("out")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = grouped.withColumn("formatted", F.array_join(F.transform("ts", lambda t: t["out"]), ""))
    back = parse(F.col("formatted"))
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sound = F.when(F.coalesce(back == source, F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("round trip failed for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate(
        "ts",
        step,
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["out"])).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + 3).alias("start"), (F.char_length(t["out"]) - 7).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return formatted.select("conv_id", sound.alias("formatted"), spans.alias("loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, written, read back and digested from what was read."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = scratch.stage(format_conversations(rows.unionByName(hard)), "chat")
    read = out.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = read.withColumn("masked", masked)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(regexp_replace(text, '\[(~*/?INST\])', '[~\1', 'g'), '<(~*/?s>)', '<~\1', 'g')"
ORACLE = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESC}) + case when role = 'assistant' then 7 else 14 + length(role) end)::bigint as formatted_chars
from t group by conv_id
"""
