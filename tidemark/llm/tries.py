"""Prefix tries of conversations: double arrays per shard, merged globally.

A conversation is a sequence of turns, a node every distinct beginning of one.
Sequences stand by their first turns and are dealt by ranges of that order to
shards, so one task sees few prefixes and a prefix of any size spreads over
many. A shard numbers its turns densely and packs its sequences into BASE and
CHECK arrays: the child of state s by turn t is BASE[s] + t, and its CHECK is s.
Walking the sequences through the arrays gives the shard's nodes. Nodes that
several shards hold, the upper ones, are merged by key, the exclusive or of
hashes of (depth, turn) along their path. Sums over subtrees are taken in each
shard over the nodes that it owns, and added up.

Conversations of more than ``SEGMENT`` turns are cut; a part hangs below the
key of what comes before it, and what it holds is added where it hangs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, crc32_sql, numbered, partitions

#: Turns of a conversation that one row holds.
SEGMENT = 256
#: Turns of a shard, about.
SHARD = 200_000
#: Slots that are looked at for one family before it goes behind all others.
TRIES = 1 << 22
#: Conversations of a family, and the remainders that say how much of its first one goes before.
FAMILY, BORROWED = 100, 6
#: Ids that agree but for so many bits are joined to one text before digests run over the texts.
IDS_BITS = 12
KEY = ["one", "two", "depth"]


def rebuilt_turns(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the family's first turns are put before each.

    Conversations have conv_id and length; turns have conv_id, depth from 1, two
    hashes of role and text, and the code points of the text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    given = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    placed = numbered(given, ["conv_id"], ["turn", "role", "text"], scratch)
    hashes = F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b")
    turns = scratch.table(placed.select("conv_id", "pos", "n", *hashes, F.length("text").cast("long").alias("chars")), "turns")
    wanted = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    own = turns.where("pos = 0").select("conv_id", "n", wanted.alias("skipped"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    heads = own.select(F.col("conv_id").alias("head"), F.col("n").alias("head_turns"))
    lead = F.least("skipped", F.coalesce("head_turns", F.lit(0)))
    own = own.join(heads, "head", "left").select("conv_id", "head", "n", "skipped", lead.alias("lead"))
    own = scratch.table(own.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0))), "conversations")
    firsts = turns.where(F.col("pos") < BORROWED - 1).select(F.col("conv_id").alias("head"), "pos", "a", "b", "chars")
    before = own.where("lead > 0").select("conv_id", "head", "lead").join(firsts, "head").where("pos < lead")
    # Conversations of any length are joined block by block.
    block = F.floor(F.col("pos") / SEGMENT)
    blocks = own.select("conv_id", "skipped", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT))).alias("block"))
    after = turns.withColumn("block", block).join(blocks, ["conv_id", "block"]).where("pos >= skipped")
    depth = F.col("pos") - F.col("skipped") + F.col("lead") + 1
    both = before.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "chars").union(after.select("conv_id", depth, "a", "b", "chars"))
    return own.select("conv_id", "length"), both


class DoubleArray:
    """BASE and CHECK of a trie; state 0 is above the roots, which are its children.

    ``base`` may be negative: only base[s] + t has to be a slot. Children of one
    turn each take the next free slots; larger families are placed first-fit.
    """

    def __init__(self) -> None:
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0], self.free_from, self.end = 0, 1, 1

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _fit(self, turns: np.ndarray) -> int:
        """The first base at which slots for all turns are free, or one behind all slots after many tries."""
        at, tried, wide = self.free_from, 0, min(4096, max(16, TRIES // 16 // len(turns)))
        while at < self.end and tried < TRIES:
            bases = np.flatnonzero(self.check[at : min(at + wide, self.end)] < 0) + at - turns[0]
            if len(bases):
                self._room(int(bases[-1] + turns[-1]) + 1)
                fits = (self.check[bases[:, None] + turns] < 0).all(axis=1)
                if fits.any():
                    return int(bases[fits.argmax()])
            tried, at = tried + len(bases) * len(turns), at + wide
        self._room(int(self.end + turns[-1] - turns[0]) + 1)
        return int(self.end - turns[0])

    def _place(self, parents: np.ndarray, bases: np.ndarray, slots: np.ndarray, owners: np.ndarray) -> None:
        self.base[parents], self.check[slots] = bases, owners
        self.end = max(self.end, int(slots.max()) + 1)

    def add_level(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Children of states without any, as distinct pairs sorted by parent, then turn."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        size = np.diff(np.r_[first, len(parents)])
        for at, n in sorted(zip(first[size > 1].tolist(), size[size > 1].tolist()), key=lambda f: -f[1]):
            base = self._fit(turns[at : at + n])
            self._place(parents[at], base, base + turns[at : at + n], parents[at])
        one = first[size == 1]
        if len(one):
            slots = np.flatnonzero(self.check[self.free_from : self.end] < 0)[: len(one)] + self.free_from
            slots = np.r_[slots, np.arange(self.end, self.end + len(one) - len(slots))]
            self._room(int(slots[-1]) + 1)
            self._place(parents[one], slots - turns[one], slots, parents[one])
        free = np.flatnonzero(self.check[self.free_from : self.end] < 0)
        self.free_from = self.free_from + int(free[0]) if len(free) else self.end

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """States after one more turn each; -1 where there is no such child."""
        slots = self.base[states] + turns
        inside = (slots > 0) & (slots < len(self.check))
        slots = np.where(inside, slots, 0)
        return np.where(inside & (self.check[slots] == states), slots, -1)


def shard_nodes(roots: np.ndarray, turns: np.ndarray, lengths: np.ndarray) -> tuple[DoubleArray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The trie of some sequences, and the walk of each through it.

    ``roots`` number what a sequence hangs below, ``turns`` are all its dense
    turn ids one after another. A level of the walk has the sequences that reach
    it, their states and the places of their last turns (of the roots: -1).
    """
    trie, starts = DoubleArray(), np.cumsum(lengths) - lengths
    alive, states, walk = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), []
    symbols, places, level = roots, np.full(len(lengths), -1), 0
    while len(alive):
        wide = int(symbols.max()) + 1
        trie.add_level(*np.divmod(np.unique(states * wide + symbols), wide))
        states = trie.step(states, symbols)
        walk.append((alive, states, places))
        on = lengths[alive] > level
        alive, states = alive[on], states[on]
        places = starts[alive] + level
        symbols, level = turns[places], level + 1
    return trie, walk


_NODES = ["shard", "node", "parent", "level", "one", "two", "depth", "conv_id", "n_convs", "chars", "childless", "hangs"]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every shard: whole rows of the partition, in order, ``SHARD`` turns at a time."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def give(rows: pa.Table) -> pa.RecordBatch:
        part, one, two, conv, count = (rows.column(c).to_numpy() for c in ("segment", "start_one", "start_two", "conv_id", "count"))
        lists = rows.column("turns").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        fields = lists.flatten()
        a, b, h1, h2, chars = (fields.field(k).to_numpy() for k in ("a", "b", "h1", "h2", "chars"))
        _, dense = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        heads, root = np.unique(np.stack([part, one, two]), axis=1, return_inverse=True)
        trie, walk = shard_nodes(root.ravel(), dense.ravel(), lengths)
        used = np.unique(np.concatenate([states for _, states, _ in walk]))
        level = np.zeros(len(trie.check), np.int64)
        keys, depth, weight, last = np.zeros((2, len(trie.check)), np.int64), np.zeros(len(trie.check), np.int64), np.zeros(len(trie.check), np.int64), np.zeros(len(trie.check), np.int64)
        smallest = np.full(len(trie.check), np.iinfo(np.int64).max)
        for at, (alive, states, places) in enumerate(walk):
            level[states] = at
            np.minimum.at(smallest, states, conv[alive])
            if at == 0:
                keys[:, states], depth[states] = heads[1:, root.ravel()], part * SEGMENT
            else:
                up = trie.check[states]
                keys[:, states] = keys[:, up] ^ np.stack([h1[places], h2[places]])
                depth[states], last[states] = depth[up] + 1, chars[places]
                np.add.at(weight, states, count[alive])
        order = used[np.argsort(level[used], kind="stable")]
        name = np.full(len(trie.check), -1)
        name[order] = np.arange(len(order))
        childless = np.ones(len(trie.check), bool)
        childless[trie.check[order]] = False
        columns = [np.full(len(order), number), name[order], np.where(level[order] > 0, name[trie.check[order]], -1), level[order], *keys[:, order], depth[order], smallest[order], weight[order], last[order], childless[order], (level[order] == 0) & (depth[order] > 0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NODES)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held.append(part)
            size += len(part.column("turns").flatten())
            if size >= SHARD:
                yield give(pa.Table.from_batches(held))
                number, held, size = number + 1, [], 0
    if held and size:
        yield give(pa.Table.from_batches(held))


def _sum_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of a shard, of what its own nodes bring."""

    def give(rows: pa.Table) -> pa.RecordBatch:
        parent, level, owner = (rows.column(c).to_numpy() for c in ("parent", "level", "conv_id"))
        owned, hangs = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("owned", "hangs"))
        sums = [rows.column(c).to_numpy().copy() for c in ("leaves", "saved")]
        children = np.zeros(len(parent), np.int64)
        ends = np.searchsorted(level, np.arange(level[-1] + 2))
        for at in range(level[-1], 0, -1):
            below = slice(ends[at], ends[at + 1])
            for s in sums:
                np.add.at(s, parent[below], s[below])
            np.add.at(children, parent[below], owned[below])
        # Below the end of a segment the sums are the next segment's, which were brought there whole.
        sums = [np.where(hangs, 0, s) for s in sums]
        above = pa.array(owner[parent], mask=(parent < 0) | ~owned)
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("one", "two", "depth", "conv_id", "n_convs")] + [above, *(pa.array(c) for c in (children, *sums))], ["one", "two", "depth", "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        shards = held.column("shard").to_numpy()
        cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for a, b in zip(np.r_[0, cuts[:-1]], cuts):
            yield give(held.slice(a, b - a))
        held = held.slice(cuts[-1]) if len(cuts) else held
    if held is not None and held.num_rows:
        yield give(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's texts, which come in order, joined by commas."""
    now, running = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now is not None:
                    done.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(text.encode())
            else:
                running.update(f",{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, running.hexdigest())], [*KEY, "ends_sha256"])


def conversation_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns stand by number, null first, then role and
    text; null roles and texts are empty; repeated rows are turns of their own;
    rows without conv_id belong to no conversation. Texts count in full. Other
    columns are not read. Without any conversation there is no node. Turns and
    nodes are told apart by 128 bits of hashes.
    """
    scratch = Scratch(rows.sparkSession)
    convs, turns = rebuilt_turns(rows, scratch)
    segment = F.floor((F.col("depth") - 1) / SEGMENT)
    hashed = turns.select("conv_id", segment.alias("segment"), F.struct("depth", "a", "b", "chars", F.xxhash64("depth", "a").alias("h1"), F.xxhash64(F.lit(1), "b", "depth").alias("h2")).alias("t"))
    parts = hashed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.bit_xor("t.h1").alias("one"), F.bit_xor("t.h2").alias("two"))
    whole = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.bit_xor(c).over(whole), F.lit(0).cast("long")).alias(f"start_{c}") for c in ("one", "two"))
    parts = scratch.table(parts.select("*", *before), "segments")

    # Equal sequences below one beginning are one row with their number.
    begin = ["segment", "start_one", "start_two"]
    distinct = parts.groupBy(*begin, "one", "two").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("count"), F.min_by("turns", "conv_id").alias("turns"))
    prefix = [F.get("turns", F.lit(k))["a"].alias(f"turn{k}") for k in range(2)]
    order = [*begin, "turn0", "turn1", "one", "two"]
    dealt = distinct.select("*", *prefix).repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    kinds = "shard long, node long, parent long, level long, one long, two long, depth long, conv_id long, n_convs long, chars long, childless boolean, hangs boolean"
    nodes = dealt.select(*begin, "conv_id", "count", "turns").mapInArrow(_build, kinds)
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where("n > 0")
    zero = F.lit(0).cast("long")
    root = root.select(F.lit(-1).cast("long"), zero, F.lit(-1).cast("long"), zero, zero, zero, zero, "first", "n", zero, F.lit(True), F.lit(False))
    nodes = scratch.table(nodes.union(root), "nodes")

    merged = nodes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"), F.min("childless").alias("childless"), F.min(F.when(~F.col("hangs"), F.col("shard"))).alias("owner")
    )
    merged = scratch.table(merged.select(*KEY, "conv_id", "n_convs", "owner", F.col("childless").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "merged")
    merged = _hang(merged, parts)
    owned = F.col("shard") == F.col("owner")
    brought = (F.when(owned & ~F.col("hangs"), F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved"))
    joined = nodes.select("shard", "node", "parent", "level", *KEY, "hangs").join(merged, KEY).select("shard", "node", "parent", "level", *KEY, "hangs", "conv_id", "n_convs", owned.alias("owned"), *brought)
    summed = joined.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_sum_subtrees, "one long, two long, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long")
    total = summed.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("conv_id", "n_convs", "parent_conv_id")), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))

    ends = convs.join(parts.groupBy("conv_id").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two")), "conv_id", "left")
    ends = ends.select(F.coalesce("one", zero).alias("one"), F.coalesce("two", zero).alias("two"), F.col("length").alias("depth"), "conv_id")
    texts = ends.groupBy(*KEY, F.shiftright("conv_id", IDS_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = texts.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids").mapInArrow(_digests, "one long, two long, depth long, ends_sha256 string")
    out = total.join(digests, KEY, "left")
    return scratch.last(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")


def _hang(merged: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes at the end of a segment bring what all later segments below them hold.

    A node counts for its smallest member, whose later segments are summed up;
    the sums go to the node that the segment hangs below.
    """
    later = parts.where("segment > 0")
    if later.isEmpty():
        return merged
    segment = F.floor((F.col("depth") - 1) / SEGMENT)
    held = merged.where(F.col("depth") > SEGMENT).groupBy("conv_id", segment.alias("segment")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    on = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)
    held = later.select("conv_id", "segment", "start_one", "start_two").join(held, ["conv_id", "segment"], "left")
    tails = held.select("start_one", "start_two", "segment", *(F.coalesce(F.sum(c).over(on), F.lit(0)).alias(c) for c in ("leaves", "saved")))
    below = tails.groupBy(F.col("start_one").alias("one"), F.col("start_two").alias("two"), (F.col("segment") * SEGMENT).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    joined = merged.join(below, KEY, "left")
    return joined.select(*KEY, "conv_id", "n_convs", "owner", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))


#: DuckDB SQL of the contract's columns.
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, {crc32_sql("conv_id")} % {BORROWED} AS h, list({{'r': role, 't': text}} ORDER BY p) AS ts FROM t GROUP BY conv_id),
r AS (SELECT l.conv_id, list_concat(coalesce(b.ts[1:l.h], []), l.ts[l.h + 1:]) AS ts FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % {FAMILY}),
e AS (SELECT conv_id, len(ts) AS length, unnest(list_transform(range(0, len(ts) + 1), lambda d: {{'d': d, 'path': ts[1:d]}})) AS x FROM r),
n AS (SELECT x.d AS d, x.path AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (length = x.d) AS ends FROM e GROUP BY x.d, x.path),
c AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].t) ELSE 0 END AS saved FROM n LEFT JOIN c USING (path)),
u AS (SELECT n_children, saved, unnest(list_transform(range(0, d + 1), lambda k: path[1:k])) AS path FROM m),
s AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY path)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN m p ON m.d > 0 AND p.path = m.path[1:m.d - 1]
"""
