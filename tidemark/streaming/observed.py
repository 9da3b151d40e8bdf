"""Observed versions of documents as a keyed stream with timers and expiry.

Rows say what was seen when: doc_id, title, published (date), observed (timestamp,
on which the watermark runs). A content that differs from the document's last
one is its next version; equal ones are duplicates. What was seen on the day of
its publication is available from then on, what was collected later only from
the midnight after the day of publication, and no version before the one it
replaces. A document that is not seen for ``quiet`` is closed by a timer and its
state leaves; seen again, it starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark.operators.ingest import available_at

c = F.col
#: What a stream gives; within the processor times are microseconds, so that no zone matters.
OUT = "doc_id long, version long, hash string, kind string, observed timestamp, available timestamp, forms long"
_INNER = OUT.replace("timestamp", "long")
#: The store that holds state for transformWithState; a setting of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Observer(StatefulProcessor):
    """State of a document: its last version (value), the hashes of its versions
    in order (list) and one timer, which is put off by whatever is seen."""

    def __init__(self, quiet: timedelta) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, hash string, observed long, available long")
        self.forms = handle.getListState("forms", "hash string")

    def _put_off(self, observed: int) -> None:
        self.handle.registerTimer((observed + self.quiet // timedelta(microseconds=1)) // 1000)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        """What a stored table says of a document before the first batch."""
        self.last.update((initialState.version, initialState.hash, initialState.observed, initialState.available))
        self.forms.appendValue((initialState.hash,))
        self._put_off(initialState.observed)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.last.get()
        version, digest, seen, available = before if before is not None else (0, None, None, None)
        forms, out = [], []
        # A batch has its rows of a key in no order.
        for r in sorted(rows, key=lambda r: (r.at, r.hash)):
            if seen is not None and r.at < seen:
                kind = "stale"
            else:
                kind = "duplicate" if digest == r.hash else "changed" if version else "new"
                if kind != "duplicate":
                    version += 1
                    available = r.available if available is None else max(available, r.available)
                    forms.append((r.hash,))
                digest, seen = r.hash, r.at
            out.append(Row(doc_id=key[0], version=version, hash=r.hash, kind=kind, observed=r.at, available=available, forms=None))
        if before is None or seen > before[2] or forms:
            # One call a key and batch each: every one goes to the state server.
            for at in list(self.handle.listTimers()) if before is not None else []:
                self.handle.deleteTimer(at)
            self.last.update((version, digest, seen, available))
            self._put_off(seen)
        if forms:
            self.forms.appendList(forms)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """Close the document: a last row with the number of its distinct contents."""
        version, digest, observed, available = self.last.get()
        forms = len({h for (h,) in self.forms.get()})
        self.last.clear()
        self.forms.clear()
        yield Row(doc_id=key[0], version=version, hash=digest, kind="closed", observed=observed, available=available, forms=forms)

    def close(self) -> None:
        pass


def observations(rows: DataFrame) -> DataFrame:
    """(doc_id, hash, observed, at, available) of rows seen; those without an id,
    a title or a time are left out, as ``normalize_poll`` calls them invalid."""
    digest = F.substring(F.sha2("title", 256), 1, 16)
    late = c("published") < F.to_date("observed")
    at = available_at(c("published"), c("observed").cast("timestamp_ntz"), F.coalesce(late, F.lit(False))).cast("timestamp")
    fine = "doc_id is not null and title is not null and observed is not null"
    return rows.where(fine).select(c("doc_id").cast("long").alias("doc_id"), digest.alias("hash"), c("observed").cast("timestamp").alias("observed"), F.unix_micros(c("observed").cast("timestamp")).alias("at"), F.unix_micros(at).alias("available"))


def observe(rows: DataFrame, quiet: timedelta, late: str = "0 seconds", known: DataFrame | None = None) -> DataFrame:
    """Versions, duplicates and closings of a stream of rows.

    ``known`` is a stored table (doc_id, version, hash, observed, available) with
    which the state of a new stream starts. The session's state store has to be
    the one of ``STATE_STORE``, its time zone UTC. Rows of one batch are put in
    order of their time; a row that comes in a later batch than a newer one of its
    document is stale, one from before the watermark is dropped.
    """
    marked = observations(rows).withWatermark("observed", late)
    start = None if known is None else known.select("doc_id", "version", "hash", *(F.unix_micros(x).alias(x) for x in ("observed", "available"))).groupBy("doc_id")
    seen = marked.groupBy("doc_id").transformWithState(Observer(quiet), _INNER, "append", "eventTime", initialState=start)
    return seen.withColumns({x: F.timestamp_micros(x) for x in ("observed", "available")})
