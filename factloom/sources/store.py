"""Tables of a graph: upserts, deletion and supersession of a paper, as set operations; and a versioned writer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import ids

_local: dict[str, str] = {}


def upsert(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key; of equally new ones the last by its text. A task keeps its best row of a key before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc(F.to_json(F.struct(*df.columns)))))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def flatten_quantity(facts: DataFrame) -> DataFrame:
    """facts with their quantity (struct value, unit, operator, raw) as columns q_value, q_unit, q_operator, q_raw; null without one."""
    return facts.select("*", *[F.col(f"quantity.{c}").alias(f"q_{c}") for c in ("value", "unit", "operator", "raw")]).drop("quantity")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends (node) exist, once for each source, target, type and relation (`rel`, null as empty, where edges have it).

    Different targets are few, and those that are missing are looked up first. Edges then travel once, in ranges of both ends,
    and their source's row, which names it, comes before them; so no end gathers its edges.
    """
    from factloom.operators import runs

    more = [c for c in ("type", "rel") if c in edges.columns]
    own = edges.where("src is not null and dst is not null")
    known = nodes.select("node").where("node is not null")
    lost = cut(own.select(ids.digest("dst").alias("_t")).distinct().join(known.select(ids.digest("node").alias("_t")), "_t", "left_anti"))
    rows = own.join(lost, ids.digest("dst") == F.col("_t"), "left_anti")
    first, last = F.lit(bytearray(b"\x00")), F.lit(bytearray(b"\x01"))
    rows = rows.select(ids.digest("src").alias("_s"), F.concat(last, ids.pack("dst")).alias("_d"), *[F.coalesce("rel", F.lit("")).alias(c) if c == "rel" else c for c in more])
    heads = known.select(ids.digest("node").alias("_s"), F.concat(first, ids.pack("node")).alias("_d"), *[F.lit("").alias(c) for c in more])
    one = rows.union(heads).repartitionByRange("_s", "_d").dropDuplicates(["_s", "_d", *more])
    found = runs.lead(one, "_s", "_d", "_n").where((F.substring("_n", 1, 1) == first) & (F.substring("_d", 1, 1) == last))
    name = lambda c: ids.unpack(F.substring(c, 2, ids.ALL))
    return found.select(name("_n").alias("src"), name("_d").alias("dst"), *more)


def scalar_props(props: Column) -> Column:
    """A map of JSON values without those that are no text, number or boolean."""
    return F.map_filter(props, lambda k, v: v.rlike(r'^(".*"|-?[0-9].*|true|false)$'))


def in_graph(rows: DataFrame, graph_id: str | None) -> DataFrame:
    """Rows of one graph, where they carry graph_id; all of them for none."""
    return rows if graph_id is None or "graph_id" not in rows.columns else rows.where(F.col("graph_id") == graph_id)


def all_entities(entities: DataFrame, graph_id: str | None = None) -> DataFrame:
    """(uuid, canonical_name, type, aliases) of a graph's entities of known types; a null name is empty, null aliases are none."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    return in_graph(entities, graph_id).where(F.col("type").isin(vocab.ENTITY_TYPES)).select("uuid", F.coalesce("canonical_name", F.lit("")).alias("canonical_name"), "type", aliases.alias("aliases"))


def all_facts(facts: DataFrame, graph_id: str | None = None) -> DataFrame:
    """(uuid, statement, frame_type, paper_ref, status, year, quantity) of a graph's facts; without value and raw text no quantity."""
    some = F.col("q_value").isNotNull() | F.coalesce(F.col("q_raw") != "", F.lit(False))
    quantity = F.when(some, F.struct(F.col("q_value").alias("value"), F.col("q_unit").alias("unit"), F.col("q_operator").alias("operator"), F.col("q_raw").alias("raw")))
    return in_graph(facts, graph_id).select("uuid", F.coalesce("statement", F.lit("")).alias("statement"), "frame_type", "paper_ref", "status", "year", quantity.alias("quantity"))


def all_edges(edges: DataFrame, graph_id: str | None = None) -> DataFrame:
    """(src, dst, type) of a graph's edges."""
    return in_graph(edges, graph_id).select("src", "dst", "type")


def paper_subgraph(facts: DataFrame, paper_ref: str, graph_id: str | None = None) -> DataFrame:
    """(uuid, frame_type) of a paper's facts."""
    return in_graph(facts, graph_id).where(F.col("paper_ref") == paper_ref).select("uuid", "frame_type")


def by_key(entities: DataFrame, key: str, graph_id: str | None = None) -> DataFrame:
    """The first entity (uuid, type, canonical_name) of a key."""
    return in_graph(entities, graph_id).where(F.col("entity_key") == key).orderBy("uuid").limit(1).select("uuid", "type", "canonical_name")


def delete_paper(facts: DataFrame, edges: DataFrame, entities: DataFrame, paper_ref: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, edges, entities without a paper: its facts, their edges, and the entities that no other fact names any more."""
    gone = cut(facts.where(F.col("paper_ref") == paper_ref).select("uuid"))  # a paper's; what follows is planned by its size
    left = edges.join(gone.select(F.col("uuid").alias("src")), "src", "left_anti").join(gone.select(F.col("uuid").alias("dst")), "dst", "left_anti")
    touched = cut(edges.join(gone.select(F.col("uuid").alias("src")), "src", "left_semi").select("dst").where("dst is not null").distinct())
    still = left.select("dst").union(left.select("src")).join(touched, "dst", "left_semi").distinct()
    orphans = touched.join(still, "dst", "left_anti").select(F.col("dst").alias("uuid"))
    return facts.where(F.col("paper_ref") != paper_ref), left, entities.join(orphans, "uuid", "left_anti")


def supersede(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Writes a table's version to its own folder; readers take the highest that is complete (Spark's _SUCCESS)."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version:012d}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, ascending: those whose folder holds Spark's _SUCCESS."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [p.getName() for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the highest complete one if none is named."""
    if version is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no complete version under {path}")
        version = found[-1]
    return spark.read.parquet(f"{path}/version={version:012d}")


def save(df: DataFrame, path: str, key: str = "paper_ref") -> int:
    """Puts rows into a table of documents: all rows of a key that df has are replaced by df's. Writes the next version, and returns
    its number; readers see the old one until it is complete. Two writers of one version: the second fails."""
    spark = df.sparkSession
    found = versions(spark, path)
    rows = supersede(read_version(spark, path, found[-1]), df, key) if found else df
    version = found[-1] + 1 if found else 0
    write_version(rows, path, version)
    return version


def get(spark: SparkSession, path: str, paper_ref: str) -> DataFrame:
    """A document's rows, none if it is unknown; the filter reaches the files."""
    return read_version(spark, path).where(F.col("paper_ref") == paper_ref)


def list_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_ref), once each."""
    return read_version(spark, path).select("paper_ref").distinct()


def get_doc(papers: DataFrame, paper_ref: str) -> DataFrame:
    """(paper_ref, title, year, n_chars, raw_text) of a paper."""
    return papers.where(F.col("paper_ref") == paper_ref).select("paper_ref", "title", "year", F.char_length("raw_text").alias("n_chars"), "raw_text")


def with_vectors(rows: DataFrame, text: Column, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows with `embedding`, made once of a text: an entity's name and aliases by blanks, a fact's statement. `embed(rows, column)` adds it."""
    return embed(rows.withColumn("_text", text), "_text").drop("_text")


def persist(facts: DataFrame, entities: DataFrame, edges: DataFrame, new_facts: DataFrame, new_entities: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph's tables with a document's rows put in: entities and facts by uuid, newest last; edges by their ends, type and relation,
    if both ends are there."""

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        """Rows are dealt before their text, which orders equally new ones, is made; an id has few rows."""
        both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
        light = both.withColumn("uuid", ids.pack("uuid")).repartition("uuid").withColumn("_u", ids.unpack("uuid"))
        text = F.to_json(F.struct(*[F.col("_u").alias("uuid") if c == "uuid" else F.col(c) for c in both.columns]))
        rank = F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("_seq"), F.desc(text)))
        return light.withColumn("_r", rank).where("_r = 1").select([F.col("_u").alias("uuid") if c == "uuid" else F.col(c) for c in both.columns]).drop("_seq")

    f, e = newest(facts, new_facts), newest(entities, new_entities)
    nodes = facts.select(F.col("uuid").alias("node"))
    for d in (new_facts, entities, new_entities):
        nodes = nodes.union(d.select("uuid"))
    return f, e, upsert_edges(edges.unionByName(new_edges, allowMissingColumns=True), nodes)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int = 0) -> DataFrame:
    """(path, length) of the files of a folder and those below, sorted, the first `limit` (0: all); their bytes are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")
    return found.limit(limit) if limit else found


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder of spark.checkpoint.dir; where none is set, on a local master, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        app = spark.sparkContext.applicationId
        if app not in _local:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            _local[app] = tempfile.mkdtemp(prefix="factloom-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        shared = f"file://{_local[app]}"
    return f"{shared.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to a new place in the shared folder and read back. Later steps start from the files, also after
    executors are lost, and are planned by their sizes."""
    path = f"{new_folder(df.sparkSession)}/cut"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
