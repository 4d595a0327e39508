"""Extracted frames into facts, entities and edges; roles of chunks and sections. A model's answers come as tables.

A frame is a row (chunk, ord, paper_ref, frame_type, slots map<string,string>, about array<struct<mention,type>>, open_edges
array<struct<src,rel,dst>>, statement, negated); chunk and ord identify it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import anchors

QUANTITY = "struct<value:double,unit:string,operator:string,uncertainty:double,lower:double,upper:double,raw:string>"


def filled(x: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(x) != "", F.lit(False))


def clean(frames: DataFrame) -> DataFrame:
    """Unknown frame types become claims; blank slots, incomplete open edges and unusable `about` entries go."""
    return frames.withColumns(
        {
            "frame_type": F.when(F.col("frame_type").isin(vocab.FRAME_TYPES), F.col("frame_type")).otherwise("ClaimFact"),
            "slots": F.map_filter(F.coalesce("slots", F.create_map().cast("map<string,string>")), lambda k, v: filled(v)),
            "about": F.filter("about", lambda a: filled(a["mention"]) & a["type"].isin(vocab.ENTITY_TYPES)),
            "open_edges": F.filter("open_edges", lambda e: filled(e["src"]) & filled(e["rel"]) & filled(e["dst"])),
            "statement": F.coalesce("statement", F.lit("")),
            "negated": F.coalesce("negated", F.lit(False)),
        }
    )


def slot_table(spark) -> DataFrame:
    """frame_type, slot, type, edge: the slot dictionary, of fixed size."""
    return spark.createDataFrame(vocab.SLOTS, "frame_type string, slot string, type string, edge string")


def mentions(frames: DataFrame) -> DataFrame:
    """(fact, paper_ref, place, mention, type, edge) of cleaned frames: known slots by the dictionary, `about` as MENTIONS."""
    f = frames.withColumn("fact", F.sha1(F.concat_ws("|", "chunk", "ord")))
    slots = f.select("fact", "paper_ref", "frame_type", F.explode("slots").alias("slot", "mention"))
    known = slots.join(F.broadcast(slot_table(frames.sparkSession)), ["frame_type", "slot"]).select("fact", "paper_ref", F.col("slot").alias("place"), "mention", "type", "edge")
    about = f.select("fact", "paper_ref", F.posexplode("about").alias("n", "a"))
    return known.unionByName(about.select("fact", "paper_ref", F.concat(F.lit("about-"), F.col("n")).alias("place"), "a.mention", "a.type", F.lit("MENTIONS").alias("edge")))


def build(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, entities and edges of cleaned frames: a fact a frame, an entity and an edge a mention; ids follow from the place.

    A fact's anchor is its first mention (slots in their order, then about), else the first eight words of its statement; where
    it stands in its paper tells `provenance`. Frames may carry source, year and quantity; facts start unverified.
    """
    from factloom.functions import text

    first = F.try_element_at(F.concat(F.map_values("slots"), F.transform("about", lambda a: a["mention"])), F.lit(1))
    words = F.filter(F.split(text.squeeze(F.col("statement")), " "), lambda w: w != "")
    anchor = F.coalesce(first, F.array_join(F.slice(words, 1, 8), " "))
    own = {"source": F.lit("text"), "year": F.lit(None).cast("int"), "quantity": F.lit(None).cast(QUANTITY)}
    more = [(F.col(c) if c in frames.columns else x).alias(c) for c, x in own.items()]
    facts = frames.select(F.sha1(F.concat_ws("|", "chunk", "ord")).alias("uuid"), "chunk", "frame_type", "paper_ref", F.nullif(F.col("statement"), F.lit("")).alias("statement"), "negated", anchor.alias("anchor"), *more, F.lit("unverified").alias("status"))
    own = mentions(frames).withColumn("uuid", F.sha1(F.concat_ws("|", "fact", "place")))
    entities = own.select("uuid", "type", F.trim("mention").alias("canonical_name"), text.key(F.col("type"), F.col("mention")).alias("entity_key"), "paper_ref")
    return facts, entities, own.select(F.col("fact").alias("src"), F.col("uuid").alias("dst"), F.col("edge").alias("type"))


def provenance(facts: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """(uuid, paper_ref, text_hash, title, start, end, anchor): where each fact's anchor stands in its paper (paper_ref, title, raw_text),
    whatever white space is between its words; where it does not stand there, the fact's chunk (chunk, start, end)."""
    at = facts.select("uuid", "paper_ref", "chunk", "anchor").join(chunks.select("chunk", "start", "end"), "chunk").join(papers.select("paper_ref", "title", "raw_text"), "paper_ref")
    found = at.withColumn("span", anchors.find(F.col("raw_text"), F.col("anchor")))
    return found.select("uuid", "paper_ref", F.sha1("raw_text").alias("text_hash"), F.nullif(F.col("title"), F.lit("")).alias("title"), F.coalesce("span.start", "start").cast("int").alias("start"), F.coalesce("span.end", "end").cast("int").alias("end"), F.nullif(F.col("anchor"), F.lit("")).alias("anchor"))


def frames_of(chunks: DataFrame, answers: DataFrame, tables_measure: bool = True) -> DataFrame:
    """Answers (chunk, ...) of the chunks that are read: not those of role 'other'; `source` tells tables from text.

    chunks: chunk, role_hint, atomic_ref. A chunk without an answer gives no frames. From tables only measurements are taken,
    where answers have a frame_type; with tables_measure off, all.
    """
    read = chunks.where(F.col("role_hint").isNull() | (F.col("role_hint") != "other"))
    told = answers.join(read.select("chunk", F.when(F.col("atomic_ref").isNotNull(), "table").otherwise("text").alias("source")), "chunk")
    return told.where("source = 'text' or frame_type = 'MaterialMeasurement'") if tables_measure and "frame_type" in answers.columns else told


def units(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """(unit_id, chunk, start, end, role, confidence) of chunks (chunk, start, end, text, atomic_ref).

    A table or figure is one result of confidence 0.5. Else each tag (chunk, ord, anchor, role, confidence) is a unit where its
    anchor is found from the chunk's start on, whatever white space is between its words: in the paper's text, where chunks have
    it (raw_text), else in the chunk's own. Where it is not found, the unit is the whole chunk; a chunk without tags is one of
    role 'other'.
    """
    whole = chunks.where("atomic_ref is not null").select(F.concat("chunk", F.lit("-u0")).alias("unit_id"), "chunk", "start", "end", F.lit("result").alias("role"), F.lit(0.5).alias("confidence"))
    rest = chunks.where("atomic_ref is null").join(tags.where("anchor is not null"), "chunk", "left")
    whole_text = "raw_text" in chunks.columns
    rest = rest.withColumn("span", anchors.find(F.col("raw_text"), F.col("anchor"), F.col("start")) if whole_text else anchors.find(F.col("text"), F.col("anchor")))
    off = F.lit(0) if whole_text else F.col("start")
    lo, hi = F.coalesce(F.col("span.start") + off, "start"), F.coalesce(F.col("span.end") + off, "end")
    none = F.col("ord").isNull()
    cut = rest.select(F.concat("chunk", F.lit("-u"), F.coalesce("ord", F.lit(0))).alias("unit_id"), "chunk", lo.alias("start"), hi.alias("end"), F.when(none, "other").otherwise(F.col("role")).alias("role"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"))
    return whole.unionByName(cut)


def label_sections(sections: DataFrame, answers: DataFrame) -> DataFrame:
    """Sections (name, role_hint) without a hint take the answer (title, role) of the same name; 'body' takes none."""
    own = answers.groupBy(F.lower(F.trim("title")).alias("t")).agg(F.min("role").alias("role"))  # of several answers the first in the alphabet
    open_ = F.col("role_hint").isNull() & filled(F.col("name")) & (F.col("name") != "body")
    return sections.join(own, open_ & (F.lower(F.trim("name")) == F.col("t")), "left").withColumn("role_hint", F.coalesce("role_hint", "role")).drop("t", "role")
