"""A stored table with one row per key that takes many small writes.

Each write adds its rows once, as a *run* of the lowest level. ``FANOUT`` runs of a level are merged into one of the next,
so a row is written again once per level, and the table is never more than a few runs per level. Which runs count is
kept as versions (``sources.versions``): a write is there wholly or not at all, and a write that comes again is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postlake.operators.store import keep_last, row_digest
from postlake.sources import versions

FANOUT = 4


class KeyedTable:
    """Rows of ``schema``, the last one per key: by ``seq`` (null is the oldest), then by the order of the writes."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], seq: str):
        self.spark, self.path, self.schema, self.keys, self.seq = spark, path.rstrip("/"), schema, list(keys), seq

    def _runs(self, runs: list[dict]) -> DataFrame:
        frames = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{r['folder']}").withColumn("_run", F.lit(r["order"])) for r in runs]
        return reduce(DataFrame.unionByName, frames)

    def _last(self, rows: DataFrame) -> DataFrame:
        return keep_last(rows, self.keys, [F.desc_nulls_last(self.seq), F.desc("_run"), F.desc(row_digest(rows))]).drop("_run")

    def _add(self, rows: DataFrame, level: int, order: int) -> dict:
        folder = versions.data_folder()
        rows.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "level": level, "order": order}

    def _commit(self, runs: list[dict], before: dict | None, txn: int | None) -> None:
        listed = {"version": (before or {"version": 0})["version"] + 1, "txn": txn, "runs": runs, "folders": [r["folder"] for r in runs]}
        versions.commit(self.spark, self.path, listed)

    def write(self, rows: DataFrame, txn: int | None = None, skip_empty: bool = False) -> None:
        """Put rows over those of the same keys. A ``txn`` that is not above the last one has been written already.

        With ``skip_empty`` a write without rows makes no version.
        """
        before = versions.latest(self.spark, self.path)
        runs, last = (before["runs"], before["txn"]) if before else ([], None)
        if txn is not None and last is not None and txn <= last:
            return
        order = max((r["order"] for r in runs), default=0) + 1
        own = rows.select(*self.schema.fieldNames()).withColumn("_run", F.lit(order))
        run, level = self._add(self._last(own), 0, order), 0
        if skip_empty and self._runs([run]).isEmpty():
            return
        runs = [*runs, run]
        while len(same := [r for r in runs if r["level"] == level]) >= FANOUT:
            merged = self._add(self._last(self._runs(same)), level + 1, max(r["order"] for r in same))
            runs, level = [*[r for r in runs if r["level"] != level], merged], level + 1
        self._commit(runs, before, last if txn is None else txn)

    def read(self, before_txn: int | None = None) -> DataFrame:
        """The newest version, or the newest one without the write ``before_txn`` and later ones; one run is a plain scan."""
        fits = (lambda v: True) if before_txn is None else (lambda v: v["txn"] is None or v["txn"] < before_txn)
        found = versions.latest(self.spark, self.path, fits)
        if found is None or not found["runs"]:
            # known to be empty when the plan is made, so joins with it vanish
            return self.spark.createDataFrame([], self.schema).filter(F.lit(False))
        if len(found["runs"]) == 1:
            return self._runs(found["runs"]).drop("_run")
        return self._last(self._runs(found["runs"]))

    def compact(self) -> None:
        """Merge all runs into one, so that readers rank nothing."""
        before = versions.latest(self.spark, self.path)
        if before and len(before["runs"]) > 1:
            runs = before["runs"]
            top = self._add(self._last(self._runs(runs)), max(r["level"] for r in runs) + 1, max(r["order"] for r in runs))
            self._commit([top], before, before["txn"])
