"""Tools, providers, hooks, workers and reducers: the plug-in surface over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.columns import argument_error
from quarrystone.operators.tables import free_names, near

@dataclass(frozen=True)
class TableTool:
    """A tool that answers from a table: one row for each combination of the arguments it ``needs``, strings all.

    ``rows`` has a column for each needed argument, non-null and unique
    together, and its other columns are the answer.
    """

    name: str
    about: str
    needs: tuple[str, ...]
    rows: DataFrame

    def answers(self) -> DataFrame:
        """The needed arguments, and the answer as JSON."""
        given = [c for c in self.rows.columns if c not in self.needs]
        return self.rows.select(*[F.col(n).cast("string").alias(n) for n in self.needs], F.to_json(F.struct(*given)).alias("data"))


def tool_listing(spark: SparkSession, tools: Iterable[TableTool]) -> DataFrame:
    """(name, definition): what a model is told of each tool, a JSON schema with every argument a required string."""
    rows = spark.createDataFrame([(t.name, t.about, list(t.needs)) for t in tools], "name string, description string, needs array<string>")
    kinds = F.map_from_arrays("needs", F.transform("needs", lambda _: F.struct(F.lit("string").alias("type"))))
    schema = F.struct(F.lit("object").alias("type"), kinds.alias("properties"), F.col("needs").alias("required"))
    return rows.select("name", F.to_json(F.struct("name", "description", schema.alias("input_schema"))).alias("definition"))


def call_tools(calls: DataFrame, tools: Iterable[TableTool], name: str = "tool", arguments: str = "arguments") -> DataFrame:
    """``calls`` with ``result`` (ok, data, error): the answer as JSON, or what is wrong, as data.

    The error is unknown_tool, the first check of ``argument_error`` that
    fails, or tool_failed where the table has no such row.  Each tool is one
    join by its arguments, against a broadcast table if that is small; a call
    with a wrong argument matches nothing, and no call is lost.
    """
    tool, raw, error, data = free_names(calls, "tool_", "raw_", "error_", "data_")
    out = calls.withColumn(error, F.lit("unknown_tool")).withColumn(data, F.lit(None).cast("string")).withColumn(tool, F.col(name)).withColumn(raw, F.coalesce(arguments, F.lit("")))
    for t in tools:
        own = F.col(tool) == t.name
        out = out.withColumn(error, F.when(own, argument_error(F.col(raw), list(t.needs))).otherwise(F.col(error)))
        keys = free_names(out, *[f"{n}_given" for n in t.needs])
        answers = t.answers().select(*[F.col(n).alias(k) for n, k in zip(t.needs, keys)], F.col("data").alias(f"{data}new"))
        asked = F.try_parse_json(F.when(own & F.col(error).isNull(), F.col(raw)))
        match = asked.isNotNull()
        for n, k in zip(t.needs, keys):
            match = match & (F.try_variant_get(asked, f"$['{n}']", "string") == F.col(k))
        out = out.join(near(answers), match, "left")
        out = out.withColumn(error, F.when(own & F.col(error).isNull() & F.col(f"{data}new").isNull(), "tool_failed").otherwise(F.col(error)))
        out = out.withColumn(data, F.coalesce(data, f"{data}new")).drop(*keys, f"{data}new")
    result = F.struct(F.col(error).isNull().alias("ok"), F.col(data).alias("data"), F.col(error).alias("error"))
    return out.select(*calls.columns, result.alias("result"))


@dataclass(frozen=True)
class Provider:
    """A model behind a call: texts in, texts out, some at a time.

    ``limit`` texts go to one call.  ``retries`` more attempts follow a
    TimeoutError or ConnectionError; after them the answers are null and the
    error is data.
    """

    answer: Callable[[list[str]], list[Any]]
    kind: str = "string"
    limit: int = 100
    retries: int = 2

    def over(self, texts: Column) -> Column:
        """(value, error, attempts) of each text; a null text is not sent."""

        @F.pandas_udf(f"value {self.kind}, error string, attempts int")
        def run(given: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in given:
                out = pd.DataFrame({"value": [None] * len(part), "error": None, "attempts": 0}, dtype=object)
                asked = [i for i, t in enumerate(part) if t is not None]
                for at in range(0, len(asked), self.limit):
                    own, error, attempts = asked[at : at + self.limit], None, 0
                    answers: list[Any] = [None] * len(own)
                    while attempts <= self.retries:
                        attempts += 1
                        try:
                            answers, error = self.answer([part.iloc[i] for i in own]), None
                            break
                        except (TimeoutError, ConnectionError) as why:
                            error = str(why)
                    for i, value in zip(own, answers):
                        out.iat[i, 0], out.iat[i, 1], out.iat[i, 2] = value, error, attempts
                yield out.astype({"attempts": "int32"})

        return run(texts)


def embed_batch(rows: DataFrame, question: str, answer: str, encoder: Callable[[list[str]], list[list[float]]], batch: int = 100, most: int = 500) -> DataFrame:
    """``rows`` with ``embedding``: the question and the first ``most`` characters of the answer go to the encoder, ``batch`` at a time."""
    text = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.substring(F.col(answer), 1, most))
    return rows.withColumn("embedding", Provider(encoder, "array<float>", batch).over(text)["value"])


@dataclass(frozen=True)
class Hook:
    """A guard before and after a step.

    ``block`` gives the reason to stop a row (null lets it pass) and ``skip``
    is true for rows that later hooks leave alone.  ``inputs`` and ``results``
    replace columns before and after the step.
    """

    priority: int
    block: Column | None = None
    skip: Column | None = None
    inputs: Mapping[str, Column] = field(default_factory=dict)
    results: Mapping[str, Column] = field(default_factory=dict)


def with_hooks(df: DataFrame, step: Callable[[DataFrame], DataFrame], chain: Iterable[Hook], reason: str = "blocked_by") -> DataFrame:
    """The step between hooks in order of priority.

    The first reason of a row stands in ``reason``; such a row keeps its input
    and its columns of the step are null.  A hook that fails ends the plan, so
    a broken guard lets nothing pass.
    """
    left, before = "hook_skips", df.columns
    df = df.withColumn(reason, F.lit(None).cast("string")).withColumn(left, F.lit(False))
    ordered = sorted(chain, key=lambda h: h.priority)
    for hook in ordered:
        live = F.col(reason).isNull() & ~F.col(left)
        if hook.block is not None:
            df = df.withColumn(reason, F.when(live, hook.block.cast("string")).otherwise(F.col(reason)))
            live = live & F.col(reason).isNull()
        for name, value in hook.inputs.items():
            df = df.withColumn(name, F.when(live, value).otherwise(F.col(name)))
        if hook.skip is not None:
            df = df.withColumn(left, F.col(left) | (live & F.coalesce(hook.skip, F.lit(False))))
    done = step(df)
    new = [c for c in done.columns if c not in df.columns]
    for name in new:
        done = done.withColumn(name, F.when(F.col(reason).isNull(), F.col(name)))
    for hook in ordered:
        for name, value in hook.results.items():
            done = done.withColumn(name, F.when(F.col(reason).isNull(), value).otherwise(F.col(name)))
    return done.select(*before, *new, reason)


def subagent(rows: DataFrame, key: str, worker: Callable[[dict[str, Any]], Mapping[str, Any]], allowed: list[str], result: str, most_steps: int = 5) -> DataFrame:
    """A worker for each row that sees the ``allowed`` columns alone and returns fields of ``result``.

    The worker is called again with its own ``state`` until it gives
    ``done``, ``most_steps`` times at most; status tells done, max_steps or
    failed, and a failure is data.
    """
    names = [part.strip().split()[0] for part in result.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                status, steps, got, state = "max_steps", 0, {}, None
                while steps < most_steps and status == "max_steps":
                    steps += 1
                    try:
                        got = dict(worker({**{c: row[c] for c in allowed}, "state": state}))
                    except Exception as why:  # a worker's failure is data
                        status, got = "failed", {"error": str(why)}
                        break
                    state = got.get("state")
                    status = "done" if got.get("done") else status
                out.append((row[key], status, steps, got.get("error"), *(got.get(n) for n in names)))
            yield pd.DataFrame(out, columns=[key, "status", "steps", "error", *names])

    kinds = dict(rows.dtypes)
    return rows.select(key, *[c for c in allowed if c != key]).mapInPandas(run, f"{key} {kinds[key]}, status string, steps int, error string, {result}")
