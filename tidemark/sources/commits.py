"""Tables under a numbered log of commits: snapshots, retries, revisions.

``log/<number>.json`` names the folder of rows that a commit brought and the
commit with which the present rows start. A file of the log is created only if
its number is free, so of two writers one gets it and the other starts again
from what is there then. Readers ask for a number and meet exactly its rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.sinks import _fs, delete_path, read_json, write_json_once

c = F.col
Build = Callable[[DataFrame | None], DataFrame | None]


class Refused(ValueError):
    """A delivery that must not become part of the store."""


class CommitLog:
    """A table whose every state has a number; 0 is the state before the first.

    A commit reads the log entries since the last replacement, so a table with
    many small appends should be replaced by itself (``compact``) now and then.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int:
        """The number of the newest commit."""
        fs, top = _fs(self.spark, f"{self.path}/log")
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def entry(self, number: int) -> dict:
        found = read_json(self.spark, self._file(number))
        if found is None:
            raise LookupError(f"{self.path} has no commit {number}")
        return found

    def read(self, number: int | None = None) -> DataFrame | None:
        """Rows as of a commit, the newest if none is named; None before the first."""
        number = self.last() if number is None else number
        if number == 0:
            return None
        newest = self.entry(number)
        entries = [self.entry(k) for k in range(newest["since"], number)] + [newest]
        return self.spark.read.schema(StructType.fromJson(newest["schema"])).parquet(*(f"{self.path}/data/{e['folder']}" for e in entries))

    def change(self, build: Build, kind: str = "append", writer: str | None = None, batch: int | None = None, tries: int = 20) -> int:
        """Commit what ``build`` makes of the newest snapshot; the commit's number.

        ``build`` is called again, on the newer snapshot, if another writer was
        first; it may return None for no commit. A ``writer`` that numbers its
        batches upwards commits each once: a batch that is not above its last
        one changes nothing.
        """
        if kind not in ("append", "replace"):
            raise ValueError(f"unknown kind {kind}")
        for _ in range(tries):
            base = self.last()
            before = self.entry(base) if base else {"since": 1, "batches": {}, "schema": None}
            if writer is not None and batch <= before["batches"].get(writer, -1):
                return base
            rows = build(self.read(base))
            if rows is None:
                return base
            if kind == "append" and before["schema"] and [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in StructType.fromJson(before["schema"])]:
                raise Refused(f"columns differ from those of {self.path}")
            folder = uuid.uuid4().hex
            rows.write.parquet(f"{self.path}/data/{folder}")
            entry = {
                "number": base + 1,
                "kind": kind,
                "folder": folder,
                "since": base + 1 if kind == "replace" or not base else before["since"],
                "schema": rows.schema.jsonValue(),
                "batches": before["batches"] | ({} if writer is None else {writer: batch}),
            }
            if write_json_once(self.spark, self._file(base + 1), entry):
                return base + 1
            delete_path(self.spark, f"{self.path}/data/{folder}")
        raise TimeoutError(f"{tries} other writers were first at {self.path}")

    def append(self, rows: DataFrame) -> int:
        return self.change(lambda _: rows)

    def replace(self, rows: DataFrame) -> int:
        return self.change(lambda _: rows, "replace")

    def compact(self) -> int:
        """The same rows in one folder; earlier numbers stay readable."""
        return self.change(lambda old: old, "replace")

    def clean(self, older_than: float = 86_400) -> int:
        """Remove folders of writers that were lost before their commit; how many.

        A writer that is still at work has a folder without an entry too:
        ``older_than``, in seconds, must exceed the longest write.
        """
        named = {self.entry(k)["folder"] for k in range(1, self.last() + 1)}
        fs, top = _fs(self.spark, f"{self.path}/data")
        gone = 0
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            if folder.getPath().getName() not in named and folder.getModificationTime() / 1000 < time.time() - older_than:
                gone += bool(fs.delete(folder.getPath(), True))
        return gone

    def _file(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}.json"


class Revisions:
    """Keyed records that are only ever added to: each change of a key's content
    is its next revision.

    A delivery is refused as a whole if it lacks keys that the store has, or has
    two contents for one key; repeated equal rows count once. Columns that are
    NULL are content like any other, in keys too. The store holds the keys,
    revision, content (a hash of all other columns by name) and those columns.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.log, self.keys = CommitLog(spark, path), keys

    def current(self, number: int | None = None) -> DataFrame | None:
        """The newest revision of each key as of a commit."""
        rows = self.log.read(number)
        if rows is None:
            return None
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*(x for x in rows.columns if x not in self.keys)), "revision").alias("_"))
        return newest.select(*self.keys, "_.*")

    def deliver(self, delivery: DataFrame, within: str | None = None) -> int:
        """Add what is new in a delivery; the commit's number, or that of the
        present one if nothing is. ``within`` is a condition on the keys: only
        keys that meet it must come again (one day's, one source's)."""
        values = sorted(x for x in delivery.columns if x not in self.keys)
        if {"revision", "content"} & set(values):
            raise Refused("revision and content are columns of the store")
        digest = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256) if values else F.lit("")
        given = delivery.select(*self.keys, F.lit(None).cast("long").alias("revision"), digest.alias("content"), F.struct(*values).alias("row") if values else F.struct(F.lit(0).alias("_")).alias("row"))

        def build(old: DataFrame | None) -> DataFrame | None:
            known = given if old is None else given.unionByName(old.select(*self.keys, "revision", "content"), allowMissingColumns=True)
            new = F.when(c("revision").isNull(), c("content"))
            of = known.groupBy(*self.keys).agg(
                F.coalesce(F.max("revision"), F.lit(0)).alias("last"),
                F.max_by("content", "revision").alias("was"),
                F.min(new).alias("content"),
                F.max(new).alias("other"),
                F.first(F.when(c("revision").isNull(), c("row")), ignorenulls=True).alias("row"),
            )
            expected = F.expr(within) if within else F.lit(True)
            lost = c("content").isNull() & F.coalesce(expected, F.lit(False))
            changed = c("content").isNotNull() & ~c("content").eqNullSafe(c("was"))
            n = of.agg(F.count_if(lost).alias("lost"), F.count_if(c("content") != c("other")).alias("twofold"), F.count_if(changed).alias("changed")).first()
            if n["lost"] or n["twofold"]:
                raise Refused(f"{n['lost']} keys have vanished, {n['twofold']} have two contents")
            if not n["changed"]:
                return None
            return of.where(changed).select(*self.keys, (c("last") + 1).alias("revision"), "content", *(c("row")[v].alias(v) for v in values))

        return self.log.change(build)
