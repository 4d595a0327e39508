"""Models from outside: requests as rows, answers as rows. A model is a callable; a table of answers is one too.

A step takes requests (request, ...) with a prompt, asks the model for each different prompt once, and joins the answers back.
An answer is JSON in the step's schema, or null where the model failed: what follows treats that as no verdict.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from factloom.sources import store

#: Takes systems and prompts of a batch, and gives an answer or None for each.
Model = Callable[[list[str], list[str]], list[str | None]]


@dataclass(frozen=True)
class Step:
    """Templates with ${name} for each variable, the answer's schema, and a bound on an answer's tokens, which the model reads."""

    name: str
    user: str
    schema: str
    system: str = ""
    max_tokens: int = 8000


def render(template: str, **variables) -> str:
    """The template with its variables filled in; one that is missing is an error, never left empty."""
    return string.Template(template).substitute({k: "" if v is None else str(v) for k, v in variables.items()})


def prompts(requests: DataFrame, step: Step) -> DataFrame:
    """requests with `system` and `prompt`: ${name} stands for the request's column of that name, null for nothing. All in the JVM."""

    def filled(template: str):
        return F.concat(*[F.lit(text) if name is None else F.coalesce(F.col(name).cast("string"), F.lit("")) for text, name in _pieces(template)])

    return requests.withColumn("system", filled(step.system)).withColumn("prompt", filled(step.user))


def ask(requests: DataFrame, step: Step, model: Model, batch: int = 32) -> DataFrame:
    """(request, answer): the parsed answer of each request (request, and the step's variables), null where the model failed or gave
    no JSON. Equal prompts are asked once; answers are written, so a lost executor asks again only for its own part."""
    own = prompts(requests, step).select("request", "system", "prompt", F.sha1(F.concat_ws("\x01", "system", "prompt")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                try:
                    told = model(part.column(1).to_pylist(), part.column(2).to_pylist())
                except Exception:  # a failed call is a missing verdict, not a failed job
                    told = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.string())], ["key", "said"])

    told = store.cut(own.select("key", "system", "prompt").dropDuplicates(["key"]).mapInArrow(run, "key string, said string"))
    return own.select("request", "key").join(told, "key").select("request", F.from_json("said", step.schema).alias("answer"))


def embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = 64, prefix: str = "", tries: int = 3) -> Callable[[DataFrame, str], DataFrame]:
    """embed(rows, column): rows with `embedding` from a model that encodes lists of texts, each with a prefix; a call that fails or
    gives too few vectors is tried again, and then fails the task. A null text counts as an empty one."""

    def encoded(texts: list[str]) -> list[list[float]]:
        for left in reversed(range(tries)):
            try:
                got = encode(texts)
                if len(got) == len(texts):
                    return got
                raise ValueError("as many vectors as texts are wanted")
            except Exception:
                if not left:
                    raise
        raise AssertionError

    def embed(rows: DataFrame, column: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    own = [prefix + (t or "") for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                    vectors = pa.array([list(map(float, v)) for v in encoded(own)], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))

    return embed


def _pieces(template: str) -> list[tuple[str, str | None]]:
    """Literal texts and names of a template in order."""
    out, at = [], 0
    for m in string.Template.pattern.finditer(template):
        out.append((template[at : m.start()], None))
        name = m.group("named") or m.group("braced")
        if m.group("escaped") is not None:
            out.append((string.Template.delimiter, None))
        elif name is None:
            raise ValueError(f"no variable after {template[m.start() : m.end()]!r}")
        else:
            out.append(("", name))
        at = m.end()
    return [*out, (template[at:], None)]
