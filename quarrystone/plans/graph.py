"""Plans built from steps: tool registries, hook chains and state graphs over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Named steps; registering a name twice is an error."""

    steps: dict[str, Step] = field(default_factory=dict)

    def register(self, name: str, step: Step) -> Registry:
        if name in self.steps:
            raise ValueError(f"{name} is registered")
        self.steps[name] = step
        return self

    def run(self, df: DataFrame, *names: str) -> DataFrame:
        for name in names:
            df = df.transform(self.steps[name])
        return df


@dataclass
class StateGraph:
    """An acyclic state graph: nodes change columns, edges may branch on a condition.

    Compiled to one projection a node, in topological order: a row's node
    applies where its path reaches it.
    """

    nodes: dict[str, dict[str, Column]] = field(default_factory=dict)
    edges: list[tuple[str, str, Column | None]] = field(default_factory=list)

    def node(self, name: str, **columns: Column) -> StateGraph:
        self.nodes[name] = columns
        return self

    def edge(self, start: str, stop: str, when: Column | None = None) -> StateGraph:
        self.edges.append((start, stop, when))
        return self

    def order(self) -> list[str]:
        left, out = set(self.nodes), []
        while left:
            ready = sorted(n for n in left if not any(b == n and a in left for a, b, _ in self.edges))
            if not ready:
                raise ValueError("the graph has a cycle")
            out += ready
            left -= set(ready)
        return out

    def compile(self, start: str) -> Step:
        order = self.order()

        def run(df: DataFrame) -> DataFrame:
            for name in order:
                into = [F.col(f"__at_{a}") & (w if w is not None else F.lit(True)) for a, b, w in self.edges if b == name]
                reached = F.lit(name == start)
                for x in into:
                    reached = reached | F.coalesce(x, F.lit(False))
                df = df.withColumn(f"__at_{name}", reached)
                df = df.withColumns({c: F.when(F.col(f"__at_{name}"), v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in self.nodes[name].items()})
            return df.drop(*[f"__at_{n}" for n in order])

        return run


def loop_until(df: DataFrame, step: Step, done: Callable[[DataFrame], bool], most: int = 10) -> DataFrame:
    """Repeat a step until ``done`` holds; rows that are not done after ``most`` rounds are an error.  Each round's rows are written, so that plans do not grow."""
    for _ in range(most):
        if done(df):
            return df
        df = cut_lineage(step(df))
    if done(df):
        return df
    raise RuntimeError(f"not done after {most} rounds")
