"""Stages of an analysis as tables in a folder, each made again only when something that it depends on has changed.

A stage's fingerprint is a digest of its name, its options and the fingerprints of what it needs; of input files it is a
digest of their paths, lengths and times. out/manifests/<stage> holds the fingerprint that out/<stage> was made with, and
the table's schema. It is replaced by an empty one before a table is written and by the new one after it, so neither a
table that was cut short nor one of other options, inputs or columns is taken for a good one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.sources import write_stage

#: To be raised when stages of equal options come to mean something else.
VERSION = 1


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def state_of_files(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of the files below a path. Their content isn't read, and one row comes to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38, 0)")
    return digest(path, *files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(each)).first())


@dataclass(frozen=True)
class Stage:
    """make gets the tables of the stages it needs, in order, and the options by name."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)
    files: tuple[str, ...] = ()


class Job:
    """Stages by name, and the folder of their tables. `made` lists the stages that this job has written."""

    def __init__(self, spark: SparkSession, out: str, stages: list[Stage]):
        self.spark, self.out = spark, out
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("stages must have different names")
        self.made: list[str] = []
        self._prints: dict[str, str] = {}
        self._tables: dict[str, DataFrame] = {}

    def order(self, name: str) -> list[str]:
        """A stage and all that it needs, each behind what it needs; ValueError where a stage is missing or needs itself."""
        out: list[str] = []

        def visit(x: str, above: tuple[str, ...]) -> None:
            if x not in self.stages or x in above:
                raise ValueError(f"stage {x} {'needs itself' if x in above else 'is unknown'}")
            if x not in out:
                for y in self.stages[x].needs:
                    visit(y, (*above, x))
                out.append(x)

        visit(name, ())
        return out

    def fingerprint(self, name: str) -> str:
        if name not in self._prints:
            s = self.stages[name]
            self._prints[name] = digest(VERSION, name, s.options, [state_of_files(self.spark, f) for f in s.files], [self.fingerprint(x) for x in s.needs])
        return self._prints[name]

    def _manifest(self, name: str) -> tuple[str, str] | None:
        try:
            row = self.spark.read.schema("fingerprint string, schema string").json(f"{self.out}/manifests/{name}").first()
        except AnalysisException:
            return None
        return (row["fingerprint"], row["schema"]) if row else None

    def _note(self, name: str, fingerprint: str, schema: str) -> None:
        s = self.stages[name]
        about = {"stage": name, "needs": json.dumps(s.needs), "options": json.dumps(s.options, sort_keys=True, default=str), "fingerprint": fingerprint, "schema": schema}
        self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in about.items())).coalesce(1).write.mode("overwrite").json(f"{self.out}/manifests/{name}")

    def _good(self, name: str) -> DataFrame | None:
        """The stage's table, if it is whole and what its manifest says is what it should be."""
        found, path = self._manifest(name), f"{self.out}/{name}"
        if found is None or found[0] != self.fingerprint(name):
            return None
        try:
            self.spark.read.text(f"{path}/_SUCCESS")
            table = self.spark.read.parquet(path)
        except AnalysisException:
            return None
        return table if table.schema.json() == found[1] else None

    def table(self, name: str) -> DataFrame:
        """The table of a stage. What it needs is looked at, and made if need be, first."""
        for x in self.order(name):
            if x not in self._tables:
                self._tables[x] = self._good(x) or self._make(x)
        return self._tables[name]

    def _make(self, name: str) -> DataFrame:
        s = self.stages[name]
        self._note(name, "", "")
        table = write_stage(s.make(*(self._tables[x] for x in s.needs), **s.options), f"{self.out}/{name}")
        self._note(name, self.fingerprint(name), table.schema.json())
        self.made.append(name)
        return table
