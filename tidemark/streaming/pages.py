"""A folder of delivered pages as a streaming source, and its refreshed table.

A page is a JSON file ``{"total": n, "items": [{"id": .., "title": .., ..}]}``
whose name sorts after those of earlier pages. A page that is no such JSON, or
whose items are not as many as it states, fails the batch that holds it: nothing
of the batch is committed, the table stays as the last good batch left it and the
stream's cursor stays before it. When the page has been delivered again, the next
refresh goes on from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyarrow import fs as pafs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.commits import CommitLog
from tidemark.sources.readers import opened
from tidemark.sources.sinks import _fs

#: Pages that one task reads.
TOGETHER = 256
ITEMS = "page string, place long, id long, title string, link string"


class BadPage(ValueError):
    """A page that cannot be taken as an answer."""


def items_of(name: str, body: bytes) -> list[tuple]:
    """Rows of a page, or the fault that it has."""
    try:
        page = json.loads(body)
        items, total = page["items"], int(page["total"])
        rows = [(name, k, int(x["id"]), x.get("title"), x.get("link")) for k, x in enumerate(items)]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise BadPage(f"{name}: {type(error).__name__}") from None
    if total != len(rows):
        raise BadPage(f"{name}: states {total} items, has {len(rows)}")
    return rows


class Pages(InputPartition):
    def __init__(self, path: str, names: list[str]) -> None:
        super().__init__(names[0])
        self.path, self.names = path, names


class PageReader(DataSourceStreamReader):
    """The offset is the name of the last page taken; the driver lists names,
    executors read and check the pages, ``TOGETHER`` in a task. Old pages may be removed:
    if the newest is among them, the offset falls back to what is left, and only
    what is delivered afterwards is read."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _names(self) -> list[str]:
        where, top = opened(self.path)
        found = where.get_file_info(pafs.FileSelector(top, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        names = [n for n in self._names() if start["after"] < n <= end["after"]]
        return [Pages(self.path, names[k : k + TOGETHER]) for k in range(0, len(names), TOGETHER)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        where, top = opened(partition.path)
        for name in partition.names:
            with where.open_input_stream(f"{top.rstrip('/')}/{name}") as stream:
                yield from items_of(name, stream.readall())

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """``spark.readStream.format("pages").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return ITEMS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(self.options["path"])


def deliver(pages: DataFrame, folder: str) -> None:
    """Write (name, total, items) rows as pages of those names; a page of the
    same name is replaced. Executors write each as a file of its own under a name
    that no reader takes and then put it in place: meant for one delivery at a time."""

    def put(rows: Iterator[Row]) -> None:
        where, top = opened(folder)
        for name, body in rows:
            staged = f"{top.rstrip('/')}/_{name}-{uuid.uuid4().hex}"
            with where.open_output_stream(staged) as stream:
                stream.write(body.encode())
            final = f"{top.rstrip('/')}/{name}.json"
            if where.get_file_info(final).is_file:  # not every file system replaces
                where.delete_file(final)
            where.move(staged, final)

    fs, top = _fs(pages.sparkSession, folder)
    fs.mkdirs(top)
    pages.select("name", F.to_json(F.struct(*(x for x in pages.columns if x != "name")))).foreachPartition(put)


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.readStream.format("pages").load(folder)


def refresh(spark: SparkSession, folder: str, store: str) -> dict:
    """Take the pages that are new into the table ``store``; how it went.

    ``status`` is ok, or stale with ``error`` if a page is bad; ``number`` is the
    table's commit, which a bad page leaves as it was. Batches carry their number
    into the table, so one that is run again after a loss counts once.
    """
    log = CommitLog(spark, f"{store}/rows")

    def take(rows: DataFrame, batch: int) -> None:
        log.change(lambda _: rows, writer="pages", batch=batch)

    query = page_stream(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return {"status": "ok", "number": log.last(), "error": None}
    except StreamingQueryException as error:
        if "BadPage" not in str(error):
            raise
        return {"status": "stale", "number": log.last(), "error": str(error).split("BadPage: ", 1)[1].splitlines()[0]}
