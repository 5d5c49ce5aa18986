"""What users plug in: named transforms and scorers, row renderers, and distillation objectives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import objectives as O
from tessera.operators.ordering import with_row_number

Transform = Callable[..., DataFrame]
Scorer = Callable[..., Column]
TRANSFORMS: dict[str, Transform] = {}
SCORERS: dict[str, Scorer] = {}


def _registered[Made](table: dict[str, Made], name: str) -> Callable[[Made], Made]:
    def register(made: Made) -> Made:
        if name in table:
            raise ValueError(f"{name} is registered already")
        table[name] = made
        return made

    return register


def transform(name: str) -> Callable[[Transform], Transform]:
    """Register a function of (df, **options) that returns a DataFrame."""
    return _registered(TRANSFORMS, name)


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a function of (**options) that returns a column of scores."""
    return _registered(SCORERS, name)


def transformed(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """df through the named transforms in order."""
    for name, options in steps:
        if name not in TRANSFORMS:
            raise ValueError(f"no transform is named {name}")
        df = TRANSFORMS[name](df, **options)
    return df


def scored(df: DataFrame, name: str, score: str = "score", **options: object) -> DataFrame:
    if name not in SCORERS:
        raise ValueError(f"no scorer is named {name}")
    return df.withColumn(score, SCORERS[name](**options))


@transform("where")
def _where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)


@transform("with")
def _with(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


@transform("keep")
def _keep(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


@scorer("perplexity")
def _perplexity(nll: str, tokens: str) -> Column:
    """exp of the mean loss; null without tokens."""
    return F.exp(F.try_divide(F.col(nll), F.nullif(F.col(tokens), F.lit(0))))


@scorer("number")
def _number(text: str, low: float, high: float) -> Column:
    """The first number of a reply, null if there is none or it lies outside [low, high]."""
    found = F.regexp_extract(F.col(text), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(found.between(low, high), found)


def rendered_rows(df: DataFrame, items: Column, keep: list[str]) -> DataFrame:
    """Map, flat-map and filter in one: ``items`` is an array of structs for each row; empty and null ones drop it."""
    return df.select(*keep, F.inline(F.filter(items, lambda x: x.isNotNull())))


def render(df: DataFrame, render_fn: Callable[[dict], object], schema: str | T.StructType, start: Callable[[], object] | None = None) -> DataFrame:
    """Rows that ``render_fn(row)`` makes: a dict is one row, a list of dicts as many, None none.

    For what columns can't say.  Rows reach a task in Arrow batches; ``start`` runs once for each task before them.
    """
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if start:
            start()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                made = render_fn(row)
                out += [] if made is None else made if isinstance(made, list) else [made]
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(kinds))

    return df.mapInArrow(run, kinds)


def render_stream(df: DataFrame, render_fn: Callable[[dict], object], schema: str | T.StructType, order: str, batch: int) -> DataFrame:
    """Rendered rows in batches of ``batch`` in the given order of what was rendered; dropped rows leave no gaps."""
    return with_row_number(render(df, render_fn, schema), order, name="_row").withColumn("batch", F.floor(F.col("_row") / batch)).drop("_row")


class DistillationObjective(Protocol):
    """Stages of a distillation step over tokens (sample, pos, student and teacher log probabilities, mask)."""

    def collect(self, tokens: DataFrame) -> DataFrame:
        """Teacher scores by sample (and place): what the objective keeps of them."""

    def group(self, scores: DataFrame) -> DataFrame:
        """One row a sample: sample, loss, active."""

    def summarise(self, groups: DataFrame) -> DataFrame:
        """One row a step: step, samples, active, loss."""


class _Stepwise:
    def summarise(self, groups: DataFrame) -> DataFrame:
        mean = F.try_divide(F.sum(F.col("loss") * F.col("active")), F.nullif(F.sum("active"), F.lit(0)))
        return groups.groupBy("step").agg(F.count(F.lit(1)).alias("samples"), F.sum("active").alias("active"), mean.alias("loss"))


class SampledReverseKl(_Stepwise):
    """Each token of the response is worth teacher less student, times ``scale``."""

    def __init__(self, scale: float = 1.0):
        self.scale = scale

    def collect(self, tokens: DataFrame) -> DataFrame:
        return tokens.where("mask > 0").select("sample", ((F.col("teacher") - F.col("student")) * self.scale).alias("gain"))

    def group(self, scores: DataFrame) -> DataFrame:
        return scores.groupBy("sample").agg((-F.avg("gain")).alias("loss"), F.count(F.lit(1)).alias("active"))


class TopKForwardKl(_Stepwise):
    """Cross entropy of the teacher's normalised top k against the student; candidates of one place stand in ``spot``."""

    def collect(self, tokens: DataFrame) -> DataFrame:
        return tokens.select("sample", "spot", "teacher", "student")

    def group(self, scores: DataFrame) -> DataFrame:
        return O.topk_forward_kl(scores, "sample", "spot").select("sample", "loss", F.col("n_positions").alias("active"))


OBJECTIVES: dict[str, Callable[..., DistillationObjective]] = {"sampled_reverse_kl": SampledReverseKl, "topk_forward_kl": TopKForwardKl}


def distillation_steps(tokens: DataFrame, objective: DistillationObjective, samples: int) -> DataFrame:
    """collect, group, batches of ``samples`` in sample order, summarise."""
    groups = with_row_number(objective.group(objective.collect(tokens)), "sample", name="_row")
    return objective.summarise(groups.withColumn("step", F.floor(F.col("_row") / samples)).drop("_row"))
