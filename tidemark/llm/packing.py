"""Best-fit packing after Martello-Toth dominance reduction.

Sequences hold up to ``capacity`` tokens, so pieces differ, as far as packing
goes, in at most ``capacity`` lengths. The plan is made from the number of
pieces of each length, whose size does not grow with the data: sets of pieces
that provably dominate every alternative are fixed first, the remainder goes
best fit, longest first. Pieces then find their place in the plan by their rank
among those of their length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoding
from tidemark.llm.common import materialize

#: Pieces that one window sorts, about.
RANKED_TOGETHER = 200_000


@dataclass
class Bins:
    """``count`` sequences, each with the same pieces: (length, how many)."""

    count: int
    items: list[tuple[int, int]]
    free: int


def dominating(left: dict[int, int], capacity: int) -> list[Bins]:
    """Fix sets that dominate all others; ``left`` keeps what is not fixed.

    With w the longest piece looked at and r the room beside it, a set with w
    is fixed if nothing fits r, if one piece fills r exactly, or if only one
    piece can go beside w: then the longest that fits.
    """
    fixed: list[Bins] = []
    for w in sorted(left, reverse=True):
        while left.get(w, 0):
            room = capacity - w
            left[w] -= 1  # one w is set aside, the rest may stand beside it
            fits = [v for v, n in left.items() if n and v <= room]
            left[w] += 1
            if not fits:
                take, items = left[w], [(w, 1)]
            else:
                best, least = max(fits), min(fits)
                second = least if left[least] - (least == w) > 1 else min((v for v in fits if v > least), default=capacity + 1)
                if best < room and least + second <= room:
                    break
                take = left[w] // 2 if best == w else min(left[w], left[best])
                items = [(w, 2)] if best == w else [(w, 1), (best, 1)]
            for v, m in items:
                left[v] -= take * m
            fixed.append(Bins(take, items, capacity - sum(v * m for v, m in items)))
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[Bins]:
    """Longest first, each into the fullest sequence with room for it."""
    open_: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for w in sorted((v for v, n in left.items() if n), reverse=True):
        n, moved = left[w], []
        for free in range(w, capacity + 1):
            while n and open_[free]:
                bins = open_[free].pop()
                m = min(free // w, n)
                full = min(bins.count, n // m)
                if full < bins.count:
                    open_[free].append(Bins(bins.count - full, bins.items, free))
                moved.append(Bins(full, [*bins.items, (w, m)], free - m * w))
                n -= full * m
            if not n:
                break
        m = capacity // w
        if n >= m:
            moved.append(Bins(n // m, [(w, m)], capacity - m * w))
        if n % m:
            moved.append(Bins(1, [(w, n % m)], capacity - n % m * w))
        for bins in moved:
            open_[bins.free].append(bins)
    return [bins for row in open_ for bins in row]


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset)."""
    left = dict(lengths)
    bins = dominating(left, capacity)
    bins += best_fit(left, capacity)
    used, runs, sequence = dict.fromkeys(lengths, 0), [], 0
    for b in bins:
        offset = 0
        for w, m in b.items:
            runs.append((w, used[w], b.count * m, m, sequence, offset))
            used[w] += b.count * m
            offset += w * m
        sequence += b.count
    return runs


@lru_cache(1)
def tokenizer(path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer file, without added special tokens.

    A rank file of the same vocabulary is a faster way to the same ids for
    texts that hold none of the tokenizer's special strings.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    if ranks_path is None:
        return lambda text: full.encode(text, add_special_tokens=False).ids
    fast, special = encoding(ranks_path, pattern).encode_ordinary, [t.content for t in full.get_added_tokens_decoder().values()]
    return lambda text: full.encode(text, add_special_tokens=False).ids if any(x in text for x in special) else fast(text)


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, pattern: str | None, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every whole text and its end id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            rows, keys = [], []
            for at in range(batch.num_rows):
                ids = array("I", encode(batch.column(1)[at].as_py() or ""))
                ids.append(end_id)
                n = len(ids)
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    keys.append(at)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b])))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), columns[0].cast(pa.int32()), *columns[1:]], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Only texts of over
    ``capacity`` ids are cut; all pieces but the first are full. Repeated rows
    and null ids keep a piece each. An empty table gives no row.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, ranks_path, pattern, capacity, end_id, id_col, text_col), "pieces")
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    salts = max(16, -(-max(lengths.values(), default=0) // RANKED_TOGETHER))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("place", within - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("base"))
    names = "w long, first long, pieces long, each long, sequence long, at long"
    runs = spark.createDataFrame(plan(lengths, capacity), names)
    # One run for each length and kind of sequence: bounded by the capacity, not by the data.
    here = (F.col("length") == F.col("w")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))
    local = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(runs), here).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(local / F.col("each"))).alias("sequence_id"),
        (F.col("at") + local % F.col("each") * F.col("w")).alias("offset"),
    )
