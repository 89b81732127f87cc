"""Named queries with their oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from postlake.plans.fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", oracle: str | None = None):
    """Register a query; ``views`` names the derived tables its oracle reads.

    The oracle is a SELECT, or further CTEs starting with a comma followed by a SELECT.
    """

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None
        if oracle is not None:
            names = views.split()
            body = oracle.strip()
            if not names and body.startswith(","):
                body = "WITH RECURSIVE " + body[1:]
            text = with_views(body, *names)
        QUERIES[name] = Query(name, build, text)
        return build

    return add


def load_all() -> dict[str, Query]:
    from postlake.plans import (  # noqa: F401
        files, logs, scoring, search, shards, store, streams, text,
    )

    return QUERIES
