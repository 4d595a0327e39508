"""Verification of facts by verdicts: tables, batches, the gate and its write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import anchors

MEAN_LEAST, RELEVANCE_LEAST, BATCH, FIRST, RATIONALE = 0.6, 0.4, 25, 20, 400  # fixed values


def verify_tables(facts: DataFrame) -> DataFrame:
    """Facts from tables that are not contested are verified, with 1 for confidence, clarity and relevance."""
    sure = (F.col("source") == "table") & (F.col("status") != "contested")
    out = facts.withColumn("status", F.when(sure, "verified").otherwise(F.col("status")))
    for c in ("confidence", "clarity", "relevance"):
        out = out.withColumn(c, F.when(sure, 1.0).otherwise(F.col(c) if c in facts.columns else F.lit(0.0)))
    return out


def batches(facts: DataFrame, size: int = BATCH) -> DataFrame:
    """(uuid, paper_ref, batch): text facts of each paper that are not contested, `size` to a request, in the order of ids."""
    n = F.row_number().over(Window.partitionBy("paper_ref").orderBy("uuid")) - 1
    return facts.where("source = 'text' and status <> 'contested'").select("uuid", "paper_ref", F.floor(n / size).cast("long").alias("batch"))


def gate(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts with the verdicts (uuid, confidence, clarity, relevance) applied: verified if their mean is 0.6 or more and
    relevance 0.4 or more, else unverified; without a verdict, or contested, unchanged."""
    mean = (F.col("confidence") + F.col("clarity") + F.col("relevance")) / 3
    good = (F.round(mean, 9) >= MEAN_LEAST) & (F.col("relevance") >= RELEVANCE_LEAST)
    told = facts.join(verdicts, "uuid", "left")
    return told.withColumn("status", F.when(F.col("confidence").isNull() | (F.col("status") == "contested"), F.col("status")).when(good, "verified").otherwise("unverified"))


def todo(facts: DataFrame) -> DataFrame:
    """Unverified facts that no verdict was asked for yet; one that failed the gate is not asked again."""
    return facts.where((F.col("status") == "unverified") & ~F.coalesce("v_checked", F.lit(False)))


def apply(facts: DataFrame, checked: DataFrame) -> DataFrame:
    """facts with the status of checked ones (uuid, status; conf and rationale, as v_conf and v_rationale, where given) written over;
    those count as checked from then on."""
    extra = [c for c in ("conf", "rationale") if c in checked.columns]
    told = facts.join(checked.select("uuid", F.col("status").alias("_s"), *[F.col(c).alias(f"_{c}") for c in extra]), "uuid", "left")
    told = told.withColumn("status", F.coalesce("_s", "status")).withColumn("v_checked", F.col("_s").isNotNull() | F.coalesce("v_checked", F.lit(False)))
    for c in extra:
        told = told.withColumn(f"v_{c}", F.coalesce(f"_{c}", f"v_{c}") if f"v_{c}" in facts.columns else F.col(f"_{c}"))
    return told.drop("_s", "_conf", "_rationale")


def requests(facts: DataFrame, evidence: DataFrame, passages: DataFrame, papers: DataFrame, first: int = FIRST) -> DataFrame:
    """(uuid, statement, quantity, source): the first facts of an answer's evidence (uuid, pos) that no verdict was asked for.

    The source is the best passages (uuid, source) of the statement's paper, else the window around its words in the paper's
    text (paper_ref, text), else empty. The limit is the feature: one answer asks for few verdicts.
    """
    few = todo(facts).drop("source").join(evidence.select("uuid", "pos"), "uuid").orderBy("pos", "uuid").limit(first)
    told = few.join(passages, "uuid", "left").join(papers.select("paper_ref", "text"), "paper_ref", "left")
    source = F.coalesce("source", anchors.window(F.col("text"), F.coalesce("statement", F.lit(""))))
    return told.select("uuid", "statement", F.col("q_raw").alias("quantity"), source.alias("source"))


def settle(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(uuid, status, conf, rationale) of requests that got a verdict (uuid, confidence, clarity, relevance, rationale); the others
    stay unchecked and are asked again. `apply` writes them to the facts."""
    mean = (F.col("confidence") + F.col("clarity") + F.col("relevance")) / 3
    good = (F.round(mean, 9) >= MEAN_LEAST) & (F.col("relevance") >= RELEVANCE_LEAST)
    own = asked.select("uuid").join(verdicts, "uuid")
    return own.select("uuid", F.when(good, "verified").otherwise("unverified").alias("status"), F.round(mean, 3).alias("conf"), F.substring(F.coalesce("rationale", F.lit("")), 1, RATIONALE).alias("rationale"))
