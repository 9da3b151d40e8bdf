"""Repeated passages, found by winnowed anchors that are extended both ways.

Of the word n-grams in a window of ``length`` words the one with the smallest
hash is the window's anchor, so equal windows have equal anchors at the same
place, and about one word in seven is an anchor. Documents meet at equal
anchors. Each occurrence is extended both ways at once, to the farthest words
that any of its windows holds. Of occurrences with an equal extension the first
keeps its windows and the others have only repeated ones; it is found within
a batch before the shuffle, and after it. Only where one anchor has several
extensions, at the ends of a passage, are the windows compared one by one.
Overlapping repeats then add up to maximal ones.

A passage that very many documents hold is one row a batch of them, an anchor
with very many extensions is dealt by extension; there are never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Words of a window that counts as repeated, and of an anchor.
LENGTH = 20
ANCHOR = 8
#: A place in a text and the text's checksum above it share a long.
PLACE_BITS = 31
#: Factors of the words' hashes: anchors, extensions, and two for windows.
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (4, 4096), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _spans(hashes: np.ndarray, starts: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hashes of the ``size`` words from each start."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        total += hashes[starts + k] * _FACTORS[lane, k]
    return _mixed(total)


class Words:
    """The words of a text, their hashes, and the anchors of its windows.

    ``anchors`` are word positions in ascending order; those of the windows
    ``first[i]`` to ``last[i]`` chose anchor i. A text of fewer than ``length``
    words has no window.
    """

    def __init__(self, text: bytes | None, length: int, anchor: int) -> None:
        # bytes.split knows the ASCII white space only, as intended.
        self.words, self.length, self.anchor = (text or b"").split(), length, anchor
        windows = max(0, len(self.words) - length + 1)
        self.anchors = self.first = self.last = np.empty(0, np.int64)
        if windows:
            digest = xxhash.xxh64_intdigest
            self.hashes = np.array([digest(w) for w in self.words], np.uint64)
            self.grams = _spans(self.hashes, np.arange(len(self.words) - anchor + 1), anchor, 0)
            chosen = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(self.grams, length - anchor + 1).argmin(axis=1)
            self.first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            self.last = np.r_[self.first[1:], windows] - 1
            self.anchors = chosen[self.first]

    def extensions(self) -> np.ndarray:
        """Hash of all words that a window with this anchor can hold; beyond the text stands zero."""
        reach = self.length - self.anchor
        padded = np.r_[np.zeros(reach, np.uint64), self.hashes, np.zeros(reach, np.uint64)]
        return _spans(padded, self.anchors, self.length + reach, 1)

    def windows_of(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that chose one of these word positions."""
        at = np.searchsorted(self.anchors, anchors)
        size = self.last[at] - self.first[at] + 1
        return np.repeat(self.first[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


_PLACES = ["anchor", "extension", "id", "place", "several"]


def _occurrences(length: int, anchor: int):
    """Anchors with their extensions, of equal ones in a batch the first alone.

    ``several`` is true where the batch holds the anchor with other extensions
    too; a row without extension then says so to other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by([("id", "ascending"), ("tie", "ascending")])
            known = batch.num_rows - batch.column(0).null_count
            anchors, extensions, rows, places = [], [], [], []
            # Arrow sorts nulls last; here they are the smallest.
            for row in [*range(known, batch.num_rows), *range(known)]:
                w = Words(batch.column(2)[row].as_py(), length, anchor)
                if len(w.anchors):
                    anchors.append(w.grams[w.anchors])
                    extensions.append(w.extensions())
                    places.append((batch.column(1)[row].as_py() << PLACE_BITS) + w.anchors)
                    rows.append(np.full(len(w.anchors), row))
            if rows:
                a, e, r, p = (np.concatenate(x) for x in (anchors, extensions, rows, places))
                order = np.lexsort((e, a))
                a, e = a[order].view(np.int64), e[order].view(np.int64)
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (e[1:] != e[:-1])])
                a, e, order = a[first], e[first], order[first]
                same = a[1:] == a[:-1]
                several = np.r_[False, same] | np.r_[same, False]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(e), batch.column(0).take(pa.array(r[order])), pa.array(p[order]), pa.array(several)], _PLACES)
                told = np.unique(a[several])
                if len(told):
                    yield pa.RecordBatch.from_arrays([pa.array(told), *(pa.nulls(len(told), t) for t in (pa.int64(), batch.column(0).type, pa.int64())), pa.array(np.ones(len(told), bool))], _PLACES)

    return run


def _first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of rows with equal anchor and extension, and whether the anchor has several."""
    held = None

    def give(rows: pa.Table) -> pa.RecordBatch:
        a = rows.column("anchor").to_numpy()
        e = rows.column("extension").combine_chunks()
        told, e = e.is_null().to_numpy(zero_copy_only=False), e.fill_null(0).to_numpy()
        runs = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        new = np.r_[True, (a[1:] != a[:-1]) | (e[1:] != e[:-1]) | (told[1:] != told[:-1])] & ~told
        several = np.logical_or.reduceat(rows.column("several").to_numpy(), runs) | (np.add.reduceat(new.astype(np.int64), runs) > 1)
        keep = pa.array(np.flatnonzero(new))
        return pa.RecordBatch.from_arrays([rows.column(c).take(keep).combine_chunks() for c in ("id", "place")] + [pa.array(np.repeat(several, np.diff(np.r_[runs, len(a)]))[new])], ["id", "place", "several"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        a = table.column("anchor").to_numpy()
        whole = int(np.searchsorted(a, a[-1])) if len(a) else 0
        if whole:
            yield give(table.slice(0, whole))
        held = table.slice(whole)
    if held is not None and held.num_rows:
        yield give(held)


def _windows(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes, rows, places = [], [], []
            for row, (text, tie, chosen) in enumerate(zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3))):
                w = Words(text.as_py(), length, anchor)
                starts = w.windows_of(np.sort(chosen.values.to_numpy()))
                lanes.append(np.stack([_spans(w.hashes, starts, length, lane) for lane in (2, 3)]))
                places.append((tie << PLACE_BITS) + starts)
                rows.append(np.full(len(starts), row))
            if rows:
                one, two = np.concatenate(lanes, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places))], ["one", "two", "id", "place"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _removed(length: int, anchor: int):
    def places(given: pa.ListScalar) -> np.ndarray:
        return np.empty(0, np.int64) if given.values is None else np.sort(given.values.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, spans, texts = [], [], [], []
            for text, sole, single in zip(*(batch.column(c) for c in (1, 2, 3))):
                w = Words(text.as_py(), length, anchor)
                n = len(w.words)
                # How many removed windows start before or at a word and reach it.
                starts = np.ones(max(0, n - length + 1), np.int64)
                starts[w.windows_of(places(sole))] = 0
                starts[places(single)] = 0
                edge = np.zeros(n + 1, np.int64)
                edge[: len(starts)] += starts
                edge[length : length + len(starts)] -= starts
                gone = np.cumsum(edge[:n]) > 0
                turns = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2).tolist()
                at, kept = 0, []
                for start, stop in turns:
                    kept += w.words[at:start]
                    at = stop
                totals.append(n)
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "stop": b} for a, b in turns])
                texts.append(b" ".join(kept + w.words[at:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(texts, pa.binary())], ["id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text), one row per row of ``docs``.

    ``spans`` are the maximal runs of words that a window covers which starts
    earlier too, in a row with a smaller id or earlier in the same; windows are
    those of the input. ``kept_text`` joins the other words by spaces. A null id
    is the smallest; rows that repeat an id stand in the order of a checksum of
    their texts, and wholly equal rows are one document, with one result. Null
    and empty texts, and those of fewer than ``length`` words, lose nothing.
    Very long texts count in full. Columns other than the two are not read. An
    empty table gives an empty result. Equality of windows is that of 128 bits
    of hashes.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.crc32(text).alias("tie"), text.cast("binary").alias("t"))

    def listed(places: DataFrame, *lists: Column) -> DataFrame:
        return places.groupBy(F.col("id").alias("of"), F.shiftright("place", PLACE_BITS).alias("tie_of")).agg(*lists)

    def place(where: Column) -> Column:
        return F.collect_list(F.when(where, F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))))

    mine = F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("tie_of"))
    found = source.mapInArrow(_occurrences(length, anchor), f"anchor long, extension long, id {kind}, place long, several boolean")
    # What is known to have several extensions need not meet the others, so no anchor is too much for a task.
    known = F.col("several") & F.col("extension").isNotNull()
    dealt = found.repartition(F.when(known, F.xxhash64("anchor", "extension")).otherwise(F.xxhash64("anchor"))).sortWithinPartitions(*_PLACES[:4])
    dealt = scratch.table(dealt.mapInArrow(_first_ones, f"id {kind}, place long, several boolean"), "anchors")

    several = listed(dealt.where("several"), place(F.lit(True)).alias("chosen"))
    windows = source.join(several, mine).select("id", "tie", "t", "chosen").mapInArrow(_windows(length, anchor), f"one long, two long, id {kind}, place long")
    windows = scratch.table(windows.groupBy("one", "two").agg(F.min(F.struct("id", "place")).alias("first")).select("first.*"), "windows")

    kept = dealt.where("not several").select("id", "place", F.lit(True).alias("sole")).union(windows.select("id", "place", F.lit(False)))
    kept = listed(kept, place(F.col("sole")).alias("soles"), place(~F.col("sole")).alias("singles"))
    out = source.join(kept, mine, "left").select("id", "t", "soles", "singles").mapInArrow(_removed(length, anchor), f"id {kind}, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_text binary")
    return scratch.last(out.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", F.col("kept_text").cast("string").alias("kept_text")), "repeats")


def summary(repeats: DataFrame) -> DataFrame:
    """The contract's columns."""
    return repeats.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL of the contract's columns.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, unnest(list_transform(range(1, len(ws) - {LENGTH - 2}), lambda i: {{'i': i, 'h': sha256(array_to_string(ws[i:i + {LENGTH - 1}], ' '))}})) AS g FROM t),
o AS (SELECT rid, g.i AS i, row_number() OVER (PARTITION BY g.h ORDER BY doc_id NULLS FIRST, g.i) AS place FROM g),
r AS (SELECT DISTINCT rid, unnest(range(i, i + {LENGTH})) AS p FROM o WHERE place > 1),
w AS (SELECT rid, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'p': i, 'w': ws[i]}})) AS w FROM t),
k AS (SELECT w.rid, count(*) AS n_kept, string_agg(w.w.w, ' ' ORDER BY w.w.p) AS kept FROM w ANTI JOIN r ON w.rid = r.rid AND w.w.p = r.p GROUP BY w.rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (rid)
"""
