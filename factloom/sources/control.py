"""The control plane as tables: teams (id, name, parent_id), users (id, name), members (user_id, team_id), graphs (id, name,
owner_team) and grants (graph_id, team, user). A change returns the new table; `store.save` keeps it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put(table: DataFrame, row: dict) -> DataFrame:
    """The table with a row of its own id in place of an older one."""
    new = table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)
    return table.where(F.col("id") != row["id"]).unionByName(new)


def add(table: DataFrame, row: dict) -> DataFrame:
    """The table of pairs with one more, once: members and grants."""
    return table.unionByName(table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)).distinct()


def ensure_user(users: DataFrame, user_id: str, name: str | None = None) -> DataFrame:
    """users, with a user of that id, named by it, if there is none."""
    new = users.sparkSession.createDataFrame([(user_id, name or user_id)], users.select("id", "name").schema)
    return users.unionByName(new.join(users.select("id"), "id", "left_anti").select("id", "name"))


def ancestors(teams: DataFrame) -> DataFrame:
    """(id, anc): all teams above each one. Paths double each round, so rounds grow with the logarithm of the depth; a cycle ends
    where no new pair comes."""
    from factloom.operators import paths

    links = teams.where("parent_id is not null").select(F.col("id").alias("a"), F.col("parent_id").alias("b"))
    return paths.closure(links).select(F.col("a").alias("id"), F.col("b").alias("anc"))


def user_teams(members: DataFrame, user_id: str) -> DataFrame:
    return members.where(F.col("user_id") == user_id).select("team_id").distinct()


def can_access(graphs: DataFrame, user_id: str, graph_id: str) -> bool:
    """Graphs are shared: whoever asks may read any that is there."""
    return not graphs.where(F.col("id") == graph_id).isEmpty()
