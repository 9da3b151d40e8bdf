"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt to buckets by pigeonhole: of ``blocks`` bit blocks, two
fingerprints within ``max_bits`` bits agree on at least ``blocks - max_bits``,
so a bucket for each choice of ``match`` blocks meets every such pair while
``blocks - match >= max_bits``. Inside a bucket the fingerprints stand in Gray
order, which puts those with common bits together; runs of them form nodes
whose shared bits are factored out, so a search adds up differences on the way
down and drops a whole group once they exceed the radius.

Groups by Jaccard similarity take the links of that index as a head start only;
a prefix filter on rare shingles adds every pair that it leaves out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components

SEED = 42
FANOUT = 4
#: Fingerprints that one index holds; larger buckets are dealt to pairs of chunks.
BUCKET = 1024
#: Queries that go down an index together, which bounds the frontier.
TOGETHER = 2048
#: Texts, about, from which common shingles are told, and at most so many of those.
SAMPLE = 20_000
COMMON = 200_000
#: Bits, in 64-bit words, of the parities that two texts are held against before
#: their shingles are; longer texts fill them, which lets more pairs through.
SKETCH = 32


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included.

    Fewer words make one shingle; no word makes none. ``bytes.lower`` and
    ``bytes.split`` know ASCII letters and white space only, as intended.
    """
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    k = min(words, len(parts))
    starts = np.concatenate([[0], ends[: len(parts) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hash gives 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * ``SKETCH`` bins whether an odd number of distinct hashes falls in it.

    The bins in which two sets differ are never more than the hashes that only
    one of them has, since what both have cancels out.
    """
    bins = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bins & 1).astype(np.uint8), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t or b"", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Hierarchical indexes of many small buckets, built and searched together.

    ``codes`` stand by (bucket, Gray rank). Level 0 has the codes; each node
    above covers up to ``FANOUT`` neighbours of one bucket and keeps the bits
    they share.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray) -> None:
        self.codes = codes
        value, mask, group = codes, np.full(len(codes), ~np.uint64(0)), bucket
        low = np.zeros(len(codes), np.uint64)
        self.levels: list[dict[str, np.ndarray]] = [{"value": value, "mask": mask, "last": np.arange(len(codes))}]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            cut = np.flatnonzero(place % FANOUT == 0)
            every = np.bitwise_and.reduceat(value, cut)
            some = np.bitwise_or.reduceat(value | ~mask, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~(every ^ some)
            size = np.diff(np.r_[cut, len(group)])
            below = self.levels[-1]
            below["residual"] = mask & ~np.repeat(shared, size)
            self.levels.append({"value": every & shared, "mask": shared, "child": cut, "size": size, "last": below["last"][cut + size - 1]})
            value, mask, group = every & shared, shared, group[cut]
        self.levels[-1]["residual"] = mask
        self.roots = group

    def pairs(self, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bits) for i < j in one bucket with at most ``radius`` bits."""
        root = np.searchsorted(self.roots, bucket)
        found = []
        for at in range(0, len(bucket), TOGETHER):
            query = np.arange(at, min(at + TOGETHER, len(bucket)))
            node, total = root[query], np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                total = total + np.bitwise_count((self.codes[query] ^ level["value"][node]) & level["residual"][node])
                keep = (total <= radius) & (level["last"][node] > query)
                query, node, total = query[keep], node[keep], total[keep]
                if depth:
                    size = level["size"][node]
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    query, node, total = np.repeat(query, size), np.repeat(level["child"][node], size) + step, np.repeat(total, size)
            found.append((query, node, total))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def closest_forest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> list[int]:
    """Places of links that span the same groups, closest links first.

    Exact where every link counts. Links that are verified later may fail, so
    whoever thins them first has to look for others between the groups.
    """
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    left, right = a.tolist(), b.tolist()
    for k in np.argsort(bits, kind="stable").tolist():
        x, y = top(left[k]), top(right[k])
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def _links(radius: int):
    def solve(key: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(code), key))
        key, code = key[order], code[order]
        many = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        many[1:] |= same
        many[:-1] |= same
        key, code = key[many], code[many]
        if not len(key):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        i, j, bits = GrayIndex(key, code).pairs(key, radius)
        kept = closest_forest(len(code), i, j, bits)
        out = code.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[i[kept]]), pa.array(out[j[kept]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, code = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            code = np.r_[code, batch.column(1).to_numpy().view(np.uint64)]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield solve(key[:whole], code[:whole])
                key, code = key[whole:], code[whole:]
        if len(key):
            yield solve(key, code)

    return run


def _bucket_keys(fp: Column, blocks: int, match: int) -> Column:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for at, chosen in enumerate(combinations(range(blocks), match)):
        mask = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(at), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def link_fingerprints(distinct: DataFrame, max_bits: int, blocks: int, match: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that span every group of fingerprints within ``max_bits``.

    ``distinct`` has one row per fingerprint, in column fp. A bucket beyond
    ``BUCKET`` rows is cut into chunks and each pair of chunks is indexed on
    its own, so no task holds more than two chunks of a bucket.
    """
    keyed = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"), blocks, match)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).alias("chunks"))
    hot = scratch.table(hot, "hot-buckets")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    split = keyed.join(hot, "key", "left")
    dealt = split.where("chunks is null").select("key", "fp").union(
        split.where("chunks is not null")
        .select("key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("d"))
        .select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp")
    )
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits), "a long, b long").distinct()


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, blocks: int = 6, match: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (hex) and component_id.

    Component_id is the smallest id reachable by links of at most ``max_bits``
    differing bits. Null and empty texts have fingerprint zero and link like
    others. Repeated rows stay, each with the same result; rows with a null id
    stay and never name a component. Columns other than the two are not read.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("first"))
    links = scratch.table(link_fingerprints(least.select("fp"), max_bits, blocks, match, scratch), "links")
    roots = connected_components(links, "a", "b")
    linked = scratch.table(roots.join(least, F.col("node") == F.col("fp")).select("fp", "root", "first"), "linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.table(least.join(linked.join(ids, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return scratch.last(fps.join(named, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id"), "groups")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, shingles): the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, shingles array<long>")


def shared_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), by shingle: what several texts of a sample share.

    They only tell which shingles are common, so that ``rarest_first`` can put
    them last. Which pairs are found does not depend on them.
    """
    every = max(1, docs.count() // SAMPLE)
    chosen = docs.select(F.col(text_col).cast("binary").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t or b"", words)).view(np.int64))], ["s"])

    counted = chosen.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") > 2)
    rows = counted.orderBy(F.col("count").desc(), "s").limit(COMMON).toPandas()
    shingles = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["count"].to_numpy(np.int64)[order]


def rarest_first(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct shingles in an order that is the same for all texts."""
    known, counts = common
    if not len(known) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return shingles[np.lexsort((shingles, np.where(known[at] == shingles, counts[at], 0)))]


def shingle_prints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, fp, contents, size, prefix, sketch) of the distinct shingles of each text.

    ``prefix`` has the first shingles in the order of ``rarest_first``: as many
    as it takes for two texts as alike as ``similarity`` to share one of them.
    ``sketch`` has their ``parities``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", words)) for t in batch.column(1).to_pylist()]
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)),
                    pa.array(size, pa.int32()),
                    pa.array([rarest_first(s, common)[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64) for s, n in zip(sets, size)], pa.list_(pa.int64())),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "fp", "contents", "size", "prefix", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long, contents long, size int, prefix array<long>, sketch array<long>")


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s, contents), one for each of both where s has several contents.

    Holds one row besides the batch, however many rows a shingle has.
    """
    kept = None  # the last new (s, contents), not given away yet
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        s, contents = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new_s = np.r_[True, s[1:] != s[:-1]]
        first = np.flatnonzero(new_s | np.r_[True, contents[1:] != contents[:-1]])
        group = np.cumsum(new_s)[first] - 1
        many = np.bincount(group) > 1
        many[0] |= several and kept is not None
        end = len(first) - 1
        give = many[group]
        give[end] = False  # waits for the next batch
        if give.any():
            yield batch.take(pa.array(first[give]))
        several, kept = bool(many[group[end]]), batch.slice(int(first[end]), 1)
    if kept is not None and several:
        yield kept


def prefix_places(prints: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, own, place, size): prefix shingles that several distinct texts have."""
    placed = prints.select(F.posexplode("prefix").alias("place", "s"), "contents").select("s", "contents", "place")
    dealt = placed.repartition("s").sortWithinPartitions("s", "contents")
    shared = scratch.table(dealt.mapInArrow(_shared_only, "s long, contents long, place int"), "shared")
    return shared.join(texts.select("contents", "own", "size"), "contents").select("s", "own", "place", "size")


def _near(similarity: float) -> Column:
    """Whether sizes, and places of the shingle in common, leave room for ``similarity``."""
    size = (F.col("a_size") >= similarity * F.col("b_size") - 1e-9) & (F.col("b_size") >= similarity * F.col("a_size") - 1e-9)
    # The first shingle in common leaves room for enough others after it.
    least = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    return size & (least >= similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - 1e-9)


def star_pairs(places: DataFrame, similarity: float) -> DataFrame:
    """(a_id, b_id): each text with the first and the last one that has a
    prefix shingle of its own, a few pairs that tie large groups together."""
    one = F.struct("own", "place", "size")
    ends = places.groupBy("s").agg(F.array(F.min(one), F.max(one)).alias("ends"))
    met = places.join(ends, "s").select(F.col("own").alias("a_id"), F.col("place").alias("a_place"), F.col("size").alias("a_size"), F.explode("ends").alias("e"))
    met = met.select("a_id", "a_place", "a_size", F.col("e.own").alias("b_id"), F.col("e.place").alias("b_place"), F.col("e.size").alias("b_size"))
    return met.where((F.col("a_id") != F.col("b_id")) & _near(similarity)).select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()


def _few_differ(similarity: float) -> Column:
    """Whether the sketches differ in no more bins than shingles may at ``similarity``."""
    bins = sum((F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(SKETCH)), F.lit(0))
    return bins <= (1 - similarity) / (1 + similarity) * (F.col("a_size") + F.col("b_size")) + 1e-9


def open_pairs(places: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a_id, b_id): every pair of texts of different groups that may reach
    ``similarity``, by a shared prefix shingle, the sizes, the places and the sketches.

    Texts that share a shingle by chance are as many pairs as the square of them;
    hardly any of those gets past the sketches.
    """
    grouped = places.join(roots, F.col("own") == F.col("node"), "left").select("s", "own", "place", "size", F.coalesce("root", "own").alias("root"))
    grouped = scratch.table(grouped, "grouped")
    mixed = grouped.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s")
    still = scratch.table(grouped.join(mixed, "s", "left_semi").join(texts.select("own", "sketch"), "own"), "open")
    a, b = (still.select("s", *(F.col(x).alias(f"{y}_{x}") for x in ("own", "place", "size", "root", "sketch"))) for y in "ab")
    on = (a["s"] == b["s"]) & (F.col("a_own") < F.col("b_own")) & (F.col("a_root") != F.col("b_root")) & _near(similarity) & _few_differ(similarity)
    return a.join(b, on).select(F.col("a_own").alias("a_id"), F.col("b_own").alias("b_id")).distinct()


def _both_ends(links: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The links with the row of each of their texts, as a and b.

    Few texts have links; the rows of others are not shuffled.
    """
    ends = scratch.table(links.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct(), "ends")
    rows = rows.join(ends, "id", "left_semi")
    a, b = (rows.select(F.col("id").alias(f"{x}_id"), F.struct(*(c for c in rows.columns if c != "id")).alias(x)) for x in "ab")
    return links.join(a, "a_id").join(b, "b_id")


def _overlap_needed(similarity: float) -> Column:
    """Common shingles that the texts of a link need for ``similarity``."""
    return similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-9


def likely(pairs: DataFrame, prints: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs that can reach ``similarity`` by what their prefixes share.

    Of the text whose prefix ends first in the common order, all shingles that
    both have are in both prefixes or come after its own.
    """
    both = _both_ends(scratch.table(pairs, "pairs"), prints.select("id", "size", "prefix"), scratch)
    rest = F.greatest(F.col("a.size") - F.size("a.prefix"), F.col("b.size") - F.size("b.prefix"))
    return both.where(F.size(F.array_intersect("a.prefix", "b.prefix")) + rest >= _overlap_needed(similarity)).select("a_id", "b_id").distinct()


def alike(links: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The links whose two shingle sets reach the Jaccard ``similarity``."""
    links = scratch.table(links, "candidates")
    ends = scratch.table(links.select(F.explode(F.array("a_id", "b_id")).alias(id_col)).distinct(), "ends")
    sets = scratch.table(shingle_sets(docs.join(ends, id_col, "left_semi"), id_col, text_col, words), "shingles")
    both = _both_ends(links, sets.withColumn("size", F.size("shingles")), scratch)
    return both.where(F.size(F.array_intersect("a.shingles", "b.shingles")) >= _overlap_needed(similarity)).select("a_id", "b_id").distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 4, blocks: int = 6, match: int = 2) -> DataFrame:
    """(id, component_id): groups linked by pairs of texts whose distinct
    shingles have a Jaccard similarity of ``similarity`` or more.

    Texts with equal shingle sets are copies, of which one stands for all.
    SimHash proposes a first set of links, closest first, and so does each
    prefix shingle with two of its texts, which ties most of the groups
    together; neither need find all. Then every pair of texts that stand in
    different groups and share a prefix shingle is compared, by sketches first,
    which leaves out no pair at ``similarity``. Ids must not be null; an empty table gives an
    empty result, and columns other than the two are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    prints = scratch.table(shingle_prints(docs, id_col, text_col, words, similarity, shared_shingles(docs, text_col, words)), "prints")
    texts = scratch.table(prints.groupBy("contents").agg(F.min("fp").alias("fp"), F.min("id").alias("own"), F.min("size").alias("size"), F.first("sketch").alias("sketch")), "texts")
    least = texts.groupBy("fp").agg(F.min("own").alias("first"))
    near = link_fingerprints(least.select("fp"), max_bits, blocks, match, scratch)
    ends = [least.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_id")) for x in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select("a_id", "b_id")
    equal = texts.join(least, "fp").where("own <> first").select(F.col("own").alias("a_id"), F.col("first").alias("b_id"))
    places = scratch.table(prefix_places(prints, texts, scratch), "places")
    links = likely(near.union(equal).union(star_pairs(places, similarity)).distinct(), prints, similarity, scratch)
    near = alike(links, docs, id_col, text_col, words, similarity, scratch)
    first = scratch.table(connected_components(near, "a_id", "b_id"), "roots")
    rest = likely(open_pairs(places, first, texts, similarity, scratch), prints, similarity, scratch)
    rest = alike(rest, docs, id_col, text_col, words, similarity, scratch)
    true = first.select(F.col("node").alias("a_id"), F.col("root").alias("b_id")).union(rest)
    roots = scratch.table(connected_components(true, "a_id", "b_id"), "roots")
    named = scratch.table(texts.join(roots, F.col("own") == F.col("node"), "left").select("contents", F.coalesce("root", "own").alias("component_id")), "components")
    return scratch.last(prints.select("id", "contents").join(named, "contents").select(F.col("id").alias(id_col), "component_id"), "groups")
