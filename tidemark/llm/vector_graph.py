"""Embedding near-duplicates through a robust-pruned flat graph.

Distinct vectors go to their nearest few cluster centres, so that shards
overlap. Each shard builds a robust-pruned graph; the adjacency lists of a
vector from all its shards are united. A search starts at a shard's medoid,
walks greedily towards its query and, once in range, expands through every
neighbour in range. Links are verified in double precision where they are
found, and the recall of the whole is audited against brute force. Should it
stay too low, vectors go to every shard in which a link of theirs can be, and
all pairs of a shard are compared, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components

#: Vectors on which centres are fitted: those with the smallest hash of their id.
SAMPLE = 20_000
MAX_CENTRES = 2_048
#: Vectors for each centre, about, and most in one chunk of a shard.
SHARD, CHUNK = 256, 1_024
#: Query vectors of the recall audit, the recall below which the index is built
#: again with more overlap and more neighbours, how often, and the recall below
#: which the exact way follows.
AUDIT, AIM, TRIES, LEAST_RECALL = 1_024, 0.97, 3, 0.9
#: Given instead of a null id to vectors that have no other; larger than any id.
NAMELESS = 1 << 62


@dataclass(frozen=True)
class Shape:
    """Centres a vector goes to, neighbours kept, search width, pruning factor."""

    overlap: int = 3
    degree: int = 16
    width: int = 12
    alpha: float = 1.2


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite part, not zero."""
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(largest > 0, largest, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def robust_prune(x: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Neighbours of each vector: near ones that no kept one is much nearer to.

    Links run both ways.
    """
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    sim = x @ x.T
    np.fill_diagonal(sim, -3)
    width = min(n - 1, 4 * degree)
    near = np.argpartition(-sim, width - 1, axis=1)[:, :width]
    gap = 2 - 2 * np.take_along_axis(sim, near, 1)
    left, rows = np.ones(near.shape, bool), np.arange(n)
    kept: list[set[int]] = [set() for _ in range(n)]
    for _ in range(degree):
        pick = np.where(left, gap, np.inf).argmin(axis=1)
        live = left[rows, pick]
        if not live.any():
            break
        chosen = near[rows, pick]
        for p, c in zip(rows[live].tolist(), chosen[live].tolist()):
            kept[p].add(c)
            kept[c].add(p)
        between = 2 - 2 * sim[chosen[:, None], near]
        left &= alpha * between > gap
        left[rows, pick] = False
    return [np.array(sorted(s), np.int64) for s in kept]


def range_search(x: np.ndarray, neighbours: np.ndarray, least: float, width: int) -> np.ndarray:
    """(n, n) booleans: vectors in range of each vector, found over the graph.

    ``neighbours`` (n, most) is filled up with -1.
    """
    n = len(x)
    medoid = int((x @ x.sum(axis=0)).argmax())
    seen, done = np.zeros((n, n), bool), np.zeros((n, n), bool)
    sim = np.full((n, n), -2.0)

    def visit(query: np.ndarray, node: np.ndarray) -> None:
        done[query, node] = True
        q, m = np.repeat(query, neighbours.shape[1]), neighbours[node].ravel()
        fresh = m >= 0
        q, m = q[fresh], m[fresh]
        fresh = ~seen[q, m]
        q, m = q[fresh], m[fresh]
        seen[q, m] = True
        for at in range(0, len(q), 1 << 16):
            a, b = q[at : at + (1 << 16)], m[at : at + (1 << 16)]
            sim[a, b] = np.einsum("ij,ij->i", x[a], x[b])

    every = np.arange(n)
    seen[:, medoid] = True
    sim[:, medoid] = x @ x[medoid]
    active = every
    while len(active):
        near = np.argpartition(-sim[active], min(width, n) - 1, axis=1)[:, : min(width, n)]
        open_ = seen[active[:, None], near] & ~done[active[:, None], near]
        score = np.where(open_, sim[active[:, None], near], -3)
        best = score.argmax(axis=1)
        live = score[np.arange(len(active)), best] > -3
        active, target = active[live], near[np.arange(len(near)), best][live]
        if len(active):
            visit(active, target)
    while True:
        query, node = np.nonzero((sim >= least) & ~done)
        if not len(query):
            break
        for at in range(0, len(query), 1 << 14):
            visit(query[at : at + (1 << 14)], node[at : at + (1 << 14)])
    found = sim >= least
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _vectors(column) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1))


def _roots(found: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place."""
    root = np.arange(len(found))
    while True:
        lower = np.minimum(root, np.where(found, root[None, :], len(found)).min(axis=1, initial=len(found)))
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def _members(classes: DataFrame, centres: np.ndarray, overlap: int, least: float | None = None) -> DataFrame:
    """(cls, n, vector, shards): where each distinct vector goes.

    With ``least``, to every centre that is the nearest one of a vector with a
    cosine of ``least`` to it: angles obey the triangle inequality, so such a
    centre is at most twice that angle farther than its own nearest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.array(batch.column(2).to_pylist(), "<f8")
            near = unit_rows(raw) @ centres.T
            r = min(overlap, len(centres))
            if least is None:
                top = np.sort(np.argpartition(-near, r - 1, axis=1)[:, :r], axis=1).tolist()
            else:
                angle = np.arccos(np.clip(near, -1, 1))
                top = [np.flatnonzero(row <= row.min() + 2 * np.arccos(least) + 1e-6).tolist() for row in angle]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(top, pa.list_(pa.int32()))], ["cls", "n", "vector", "shards"])

    return classes.select("cls", "n", F.col("v").cast("array<double>")).mapInArrow(run, "cls long, n long, vector binary, shards array<int>")


def _units(members: DataFrame) -> DataFrame:
    """(unit, cls, n, vector, units): shards, the large ones as pairs of chunks.

    The sizes of shards are as many numbers as there are centres at most.
    """
    sizes = {r["shard"]: r["count"] for r in members.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()}
    chunks = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, -(-n // CHUNK)))) if sizes else F.create_map(F.lit(-1), F.lit(1))

    def of(shard: Column) -> Column:
        many = F.element_at(chunks, shard)
        own = F.pmod(F.xxhash64("cls"), many).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda d: F.xxhash64(shard, F.least(own, d), F.greatest(own, d)))

    placed = members.withColumn("units", F.flatten(F.transform("shards", of)))
    return placed.select(F.explode("units").alias("unit"), "cls", "n", "vector", "units")


def _adjacency(units: DataFrame, shape: Shape) -> DataFrame:
    """(cls, near): the united adjacency lists of all shards."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["cls"].to_numpy()
        lists = robust_prune(_vectors(group["vector"]), shape.degree, shape.alpha)
        return pd.DataFrame({"cls": ids, "near": [ids[x] for x in lists]})

    built = units.groupBy("unit").applyInPandas(build, "cls long, near array<long>")
    return built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search(units: DataFrame, adjacency: DataFrame | None, least: float, shape: Shape) -> DataFrame:
    """(cls, links, root): weighted links of each vector, each pair counted in
    one of the shards that hold both, and its group within the shard.

    Without adjacency lists all pairs of a shard are compared.
    """

    exact = adjacency is None

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        ids, weight = group["cls"].to_numpy(), group["n"].to_numpy()
        x = _vectors(group["vector"])
        if exact:
            found = x @ x.T >= least
            np.fill_diagonal(found, False)
        else:
            place = {c: k for k, c in enumerate(ids.tolist())}
            lists = [[place[c] for c in near.tolist() if c in place] if near is not None else [] for near in group["near"]]
            padded = np.full((len(ids), max(1, *map(len, lists))), -1, np.int64)
            for k, near in enumerate(lists):
                padded[k, : len(near)] = near
            found = range_search(x, padded, least, shape.width)
        a, b = np.nonzero(found)
        units_of = np.full((len(ids), max(map(len, group["units"]))), np.iinfo(np.int64).min)
        for k, u in enumerate(group["units"]):
            units_of[k, : len(u)] = u
        here, links = group["unit"].iloc[0], np.zeros(len(ids), np.int64)
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            common = np.full(len(i), np.iinfo(np.int64).max)
            for k in range(units_of.shape[1]):
                u = units_of[i, k]
                shared = (units_of[j] == u[:, None]).any(axis=1) & (u != np.iinfo(np.int64).min)
                common = np.where(shared, np.minimum(common, u), common)
            np.add.at(links, i[common == here], weight[j[common == here]])
        return pd.DataFrame({"cls": ids, "links": links, "root": ids[_roots(found)]})

    linked = units if exact else units.join(adjacency, "cls", "left")
    return linked.groupBy("unit").applyInPandas(run, "cls long, links long, root long")


def audit_recall(classes: DataFrame, found: DataFrame, least: float) -> float | None:
    """Share of the true links of ``AUDIT`` vectors that the index found, None
    if they have none.

    Those vectors are compared with all others in blocks.
    """
    asked = classes.orderBy(F.xxhash64(F.lit(3), "cls")).limit(AUDIT)
    rows = asked.select("cls", F.col("v").cast("array<double>").alias("v")).collect()  # AUDIT rows at most
    if not rows:
        return None
    ids, query = np.array([r["cls"] for r in rows]), unit_rows(np.array([r["v"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = query @ unit_rows(np.array(batch.column(2).to_pylist(), float)).T >= least
                near &= ids[:, None] != batch.column(0).to_numpy()[None, :]
                total += near @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["cls", "true"])

    true = classes.select("cls", "n", F.col("v").cast("array<double>")).mapInArrow(run, "cls long, true long").groupBy("cls").agg(F.sum("true").alias("true"))
    row = true.join(found, "cls").agg(F.sum("links"), F.sum("true")).first()
    return row[0] / row[1] if row[1] else None


def _linked(classes: DataFrame, count: int, least: float, shape: Shape, scratch: Scratch) -> tuple[DataFrame, float | None]:
    """(cls, links, root) of vectors of one length, and the audited recall."""
    sample = classes.orderBy(F.xxhash64("cls")).limit(SAMPLE).select(F.col("v").cast("array<double>").alias("v")).collect()
    centres = fit_centres(unit_rows(np.array([r["v"] for r in sample])), min(MAX_CENTRES, -(-count // SHARD)))
    for _ in range(TRIES):
        units = scratch.table(_units(_members(classes, centres, shape.overlap)), "units")
        found = scratch.table(_search(units, _adjacency(units, shape), least, shape), "found")
        recall = audit_recall(classes, found.groupBy("cls").agg(F.sum("links").alias("links")), least)
        if recall is None or recall >= AIM:
            break
        shape = replace(shape, overlap=shape.overlap + 2, degree=2 * shape.degree, width=2 * shape.width)
    # Without a link among the audited vectors nothing is known of the others.
    if (recall is None and count > AUDIT) or (recall is not None and recall < LEAST_RECALL):
        units = scratch.table(_units(_members(classes, centres, shape.overlap, least)), "units")
        found, recall = scratch.table(_search(units, None, least, shape), "found"), 1.0
    return found, recall


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shape: Shape = Shape()) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept and audit_recall.

    Vectors that are null, empty or zero, or hold null or non-finite parts,
    link with nothing. Equal vectors are one class of which all members link;
    vectors of different lengths have no cosine and never link. Repeated rows
    stay; rows that repeat an id with other vectors are vectors of their own,
    which link only by what they are; a row with a null id counts as a link of
    others but never names a component and is not kept. An empty table gives an empty result; columns
    other than the two are not read. The recall is that of links between
    different vectors: the lowest of all lengths, null where there is no link.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(v), v).alias("v"))
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("v"), 3)
    grouped = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    # An id that stands for different vectors names the first of them; the others are as if without.
    nth = F.row_number().over(Window.partitionBy(F.coalesce("name", nameless)).orderBy(F.xxhash64("v"), "v"))
    cls = F.when(F.col("name").isNotNull() & (nth == 1), F.col("name")).otherwise(nameless)
    grouped = scratch.table(grouped.withColumn("cls", cls), "classes")
    found, recalls = None, []
    for d, count in grouped.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # lengths of vectors are few
        links, recall = _linked(grouped.where(F.size("v") == d), count, least, shape, scratch)
        found = links if found is None else found.union(links)
        recalls.append(recall)
    recall = min((r for r in recalls if r is not None), default=None)
    if found is None:
        found = grouped.select("cls", F.lit(0).cast("long").alias("links"), F.col("cls").alias("root"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "cls", "root")
    named = grouped.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    named = scratch.table(named.select(F.col("v").alias("same"), "name", "cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cls").alias("root")), "named")
    hidden = named.where(f"cls >= {NAMELESS} and name is not null").groupBy("root").agg(F.min("name").alias("hidden"))
    # Ids that stand for several vectors are the exception; without any, no component meets in one task.
    named = named.withColumn("hidden", F.lit(None).cast("long")) if hidden.isEmpty() else named.join(hidden, "root", "left")
    joined = rows.join(named, F.col("v") == F.col("same"), "left")
    component = F.coalesce(F.least(F.when(F.col("root") < NAMELESS, F.col("root")), F.col("hidden")), "id")
    out = joined.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
    )
    return scratch.last(out, "vectors")
