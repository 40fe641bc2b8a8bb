"""A journal of the tables that a job writes: a table counts once its commit record is there, whatever stopped the run before."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexvane.sources import registry
from lexvane.sources.tables import write_table


class Journal:
    """Tables under one folder, each written to a staging folder, checked, moved to its place, recorded, and put into the registry.

    The commit record, a file that is moved into the journal whole, is the only mark of completeness. A staged or moved table without
    one is written anew; a recorded table that the registry lacks is registered by the next run. after is told each step when it
    is done (staged, renamed, recorded, registered), with the table's name.
    """

    def __init__(self, spark: SparkSession, root: str, resume: bool = False, after: Callable[[str, str], None] | None = None):
        self.spark, self.root, self.resume = spark, root.rstrip("/"), resume
        self.after = after or (lambda step, name: None)
        self._known: set[str] | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _move(self, source: str, target: str) -> None:
        fs, at = self._at(target)
        fs.mkdirs(at.getParent())
        if not fs.rename(self._at(source)[1], at):
            raise OSError(f"{source} can't be moved to {target}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def _entry_path(self, name: str) -> str:
        return f"{self.root}/_journal/{name.replace('/', '.')}.json"

    def entry(self, name: str) -> dict | None:
        """What is recorded of a table: rows, counts (by bucket) and its registry records; None for a table that is not complete."""
        fs, at = self._at(self._entry_path(name))
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _record(self, name: str, entry: dict) -> None:
        target = self._entry_path(name)
        fs, draft = self._at(f"{self.root}/_journal/_{name.replace('/', '.')}.draft")
        out = fs.create(draft, True)
        out.write(json.dumps(entry).encode())
        out.close()
        self._move(str(draft.toString()), target)

    def _register(self, name: str, entry: dict) -> None:
        """Put those records into the registry that it doesn't hold."""
        if self._known is None:
            self._known = registry.known_ids(self.spark, self.path("registry"))
        if new := [r for r in entry["records"] if r["dataset_id"] not in self._known]:
            registry.register(registry.metadata(self.spark, new).coalesce(1), self.path("registry"))
            self._known |= {r["dataset_id"] for r in new}
        self.after("registered", name)

    def write(self, name: str, make: Callable[[], DataFrame], describe: Callable[[DataFrame, int], dict] | None = None, partition_by: list[str] | None = None) -> None:
        """Write the table that make gives, unless it is complete already (without resume: an error).

        describe gets the staged table and the number of rows that went into it, counted on their way; it raises if something is
        wrong, and gives what is to be recorded: counts, and records for the registry.
        """
        final, staged = self.path(name), self.path(f"_staging/{name}")
        if entry := self.entry(name):
            if not self.resume:
                raise ValueError(f"{final} is complete already")
            self._register(name, entry)
            return
        fs, at = self._at(final)
        if fs.exists(at) and not self.resume:
            raise ValueError(f"{final} is there already")
        self.delete(staged)
        self.delete(final)
        seen = Observation()
        write_table(make().observe(seen, F.count("*").alias("rows")), staged, partition_by=partition_by)
        self.after("staged", name)
        rows = int(seen.get["rows"])
        told = describe(self.spark.read.parquet(staged), rows) if describe else {}
        entry = {"rows": rows, "counts": {}, "records": []} | told
        self._move(staged, final)
        self.after("renamed", name)
        self._record(name, entry)
        self.after("recorded", name)
        self._register(name, entry)
