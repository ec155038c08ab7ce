"""Queries that users add by name, with typed parameters that are checked before a plan is built."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Name -> builder (spark, **parameters) -> DataFrame. Names are unique."""

    def __init__(self):
        self.by: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str):
        def f(build: Callable[..., DataFrame]):
            if name in self.by:
                raise ValueError(f"{name} is taken")
            self.by[name] = build
            return build

        return f

    def remove(self, name: str) -> None:
        del self.by[name]

    def run(self, spark: SparkSession, name: str, **parameters) -> DataFrame:
        """Unknown parameters and missing ones raise a TypeError, values of another type than annotated too."""
        build = self.by[name]
        signature = inspect.signature(build)
        bound = signature.bind(spark, **parameters)
        bound.apply_defaults()
        for k, v in list(bound.arguments.items())[1:]:
            kind = inspect.get_annotations(build, eval_str=True).get(k)
            if isinstance(kind, type) and v is not None and not isinstance(v, kind):
                raise TypeError(f"{k} must be {kind.__name__}")
        return build(*bound.args, **bound.kwargs)

    def as_table_functions(self, spark: SparkSession) -> None:
        """Each query as a temporary view that SQL can name, where it needs no parameter."""
        for name, build in self.by.items():
            needed = [p for p in list(inspect.signature(build).parameters.values())[1:] if p.default is p.empty]
            if not needed:
                build(spark).createOrReplaceTempView(name)


def safe_predicate(f: Callable[..., bool], *columns: str) -> Column:
    """A user's Python predicate; where it raises, the row doesn't pass. It sees rows one by one, Spark sends them in Arrow batches."""

    def one(values: tuple) -> bool:
        try:
            return bool(f(*values))
        except Exception:
            return False

    @F.arrow_udf("boolean")
    def test(*batch: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in zip(*(c.to_pylist() for c in batch))], pa.bool_())

    return test(*columns)
