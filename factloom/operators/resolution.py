"""Answers of a model about entities and relations, applied to the graph as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.extraction import filled

#: relations that an answer may add (fixed values)
HIERARCHY = ["SUBTYPE_OF", "PART_OF"]


def names(entities: DataFrame) -> DataFrame:
    """(grp, name, uuid): what a name in an answer about a group stands for; canonical names go before aliases."""
    own = entities.select("grp", F.col("canonical_name").alias("name"), "uuid", F.lit(0).alias("prio"))
    other = entities.select("grp", F.explode("aliases").alias("name"), "uuid", F.lit(1).alias("prio"))
    return own.unionByName(other).groupBy("grp", "name").agg(F.min(F.struct("prio", "uuid")).alias("x")).select("grp", "name", "x.uuid")


def clean_clusters(clusters: DataFrame, least: int = 2) -> DataFrame:
    """clusters (names array) with names trimmed and blank ones gone; those with fewer than two names left go."""
    kept = F.filter(F.transform("names", lambda n: F.trim(n)), filled)
    return clusters.withColumn("names", kept).where(F.size("names") >= least)


def merges(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(old, canon) of clusters (grp, cluster, pos, name): each goes to the cluster's first known entity.

    Blank and unknown names go; a cluster of one entity merges nothing; an entity named in several clusters follows the first of
    them, and one that is itself a first of an earlier or the same cluster stays.
    """
    m = clusters.where(filled(F.col("name"))).join(names(entities), ["grp", "name"]).groupBy("grp", "cluster", "uuid").agg(F.min("pos").alias("pos"))
    first = m.groupBy("grp", "cluster").agg(F.min(F.struct("pos", "uuid")).alias("f"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("grp", "cluster", F.col("f.uuid").alias("canon"))
    to = m.join(first, ["grp", "cluster"]).where("uuid <> canon").groupBy("uuid").agg(F.min(F.struct("grp", "cluster", "canon")).alias("x")).select(F.col("uuid").alias("old"), "x.canon")
    return to.join(first.select(F.col("canon").alias("old")).distinct(), "old", "left_anti")


def relations(entities: DataFrame, edges: DataFrame, answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """New (src, dst, type) of answers (grp, child, parent, rel), with merged entities replaced; no loops, none known already."""
    n = names(entities)
    wanted = answers.where(filled(F.col("child")) & filled(F.col("parent"))).withColumn("type", F.upper("rel")).where(F.col("type").isin(HIERARCHY))
    ends = wanted.join(n.select("grp", F.col("name").alias("child"), F.col("uuid").alias("c")), ["grp", "child"]).join(n.select("grp", F.col("name").alias("parent"), F.col("uuid").alias("p")), ["grp", "parent"])
    for end in ("c", "p"):
        ends = ends.join(mapping.select(F.col("old").alias(end), F.col("canon").alias(f"{end}_new")), end, "left").withColumn(end, F.coalesce(f"{end}_new", end))
    return ends.select(F.col("c").alias("src"), F.col("p").alias("dst"), "type").where("src <> dst").distinct().join(edges, ["src", "dst", "type"], "left_anti")


def canon_predicates(edges: DataFrame, answers: DataFrame, core: list[str]) -> DataFrame:
    """Open edges (type OPEN, rel, rel_def) whose relation has an answer (rel, core_type) among `core` become edges of that type."""
    one = answers.where(F.col("core_type").isin(core)).groupBy("rel").agg(F.min("core_type").alias("core_type"))  # of several answers the first in the alphabet
    told = edges.join(one, "rel", "left")
    hit = (F.col("type") == "OPEN") & F.col("core_type").isNotNull()
    clear = lambda c: F.when(~hit, F.col(c)).alias(c)
    return told.select("src", "dst", F.when(hit, F.col("core_type")).otherwise(F.col("type")).alias("type"), clear("rel"), clear("rel_def"))


def stitch(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """SUPPORTED_BY edges from claims to those of their candidate measurements that were approved (claim, measurement)."""
    ok = candidates.join(approved, ["claim", "measurement"], "left_semi").distinct()
    return ok.select(F.col("claim").alias("src"), F.col("measurement").alias("dst"), F.lit("SUPPORTED_BY").alias("type"))
