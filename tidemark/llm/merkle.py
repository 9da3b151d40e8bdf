"""A Merkle manifest of a data set: digests, inclusion proofs, verification.

Each row is a leaf. The leaves of a source form a tree of runs of three, the
tops of the sources another. A level is a pair of window columns: lag and lead
at the fixed distance of that level's nodes, masked by a node's slot in its run
and by the run's length, give the siblings; the first child of a run hashes the
parent. ``LEVELS`` levels share one window over chunks of 3^LEVELS places, which
a run never crosses; the tops of the chunks are the rows of the next round. So
no source, however large, has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, crc32_sql, numbered

FAN = 3
#: Levels that are built in one round; a chunk has FAN ** LEVELS places.
LEVELS = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value with its length in bytes before it, null as a dash."""

    def one(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(one(v) for v in values)), 256)


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes with their chunk, their siblings on each level of it (path) and what its first node has become (up)."""
    order = Window.partitionBy("tree", "chunk").orderBy("pos")
    pos, n = F.col("pos"), F.col("n")
    t = nodes.withColumn("chunk", F.floor(pos / FAN**levels)).withColumn("d0", F.col("digest"))
    for level in range(levels):
        step, digest = FAN**level, F.col(f"d{level}")
        node, count = F.floor(pos / step), F.ceil(n / step)
        slot = node % FAN
        run = F.least(F.lit(FAN), count - (node - slot))
        left = F.concat(*(F.when(slot >= k, F.lag(digest, k * step).over(order)).otherwise("") for k in range(FAN - 1, 0, -1)))
        right = F.concat(*(F.when(slot + k < run, F.lead(digest, k * step).over(order)).otherwise("") for k in range(1, FAN)))
        leads = (pos % step == 0) & (count > 1)
        t = t.withColumn(f"s{level}", F.when(leads, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(leads & (slot == 0), F.sha2(F.concat(digest, F.col(f"s{level}.right")), 256)).when((pos % step == 0) & (count == 1), digest)
        t = t.withColumn(f"d{level + 1}", parent)
    # The row that leads a node is the last one before its descendants that has siblings.
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    path = [F.when(F.ceil(n / FAN**level) > 1, F.last(f"s{level}", ignorenulls=True).over(so_far)) for level in range(levels)]
    t = t.withColumn("path", F.array(*path))
    return t.select(*nodes.columns, "chunk", F.filter("path", lambda s: s.isNotNull()).alias("path"), F.col(f"d{levels}").alias("up"))


def _prove(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame], scratch: Scratch, levels: int) -> DataFrame:
    """``nodes`` (tree, pos, n, digest and more) with above, the siblings up to the root, subroot and root.

    ``crown`` gives the last two and what is above a tree for the tops of the trees.
    """
    span, t = FAN**levels, _climb(nodes, levels)
    if (nodes.agg(F.max("n")).first()[0] or 0) <= span:
        t = t.join(crown(t.where("pos = 0").select("tree", F.col("up").alias("digest"))), "tree")
    else:
        up = t.where(F.col("pos") % span == 0).select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("up").alias("digest"))
        above = _prove(scratch.table(up, "nodes"), crown, scratch, levels)
        t = t.join(above.select("tree", F.col("pos").alias("chunk"), "above", "subroot", "root"), ["tree", "chunk"])
    return t.select(*nodes.columns, F.concat("path", "above").alias("above"), "subroot", "root")


def merkle_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, tampered, above, subroot and root.

    ``above`` lists, from the leaf to the root, the digests that stand left and
    right of the node there; ``tampered`` is the leaf without the line ends of
    its text, where an even crc32 of doc_id asks for it, else null. Leaves of a source stand by doc_id, null first, rows
    that repeat it by their digest; a null source is a source of its own and
    comes first. Null doc_ids are never tampered with. Texts count in full; other
    columns are not read; an empty table has no leaf and gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    values = [F.col(c) for c in FIELDS]
    altered = values[:-1] + [F.translate("text", "\n", "")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(altered))
    # The byte order of these names is that of the sources, null first.
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    leaves = scratch.table(docs.select("doc_id", "source", tree.alias("tree"), leaf_digest(values).alias("digest"), tampered.alias("tampered")), "leaves")

    def alone(tops: DataFrame) -> DataFrame:
        return tops.select("tree", F.array().cast(PATH).alias("above"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def sources(tops: DataFrame) -> DataFrame:
        placed = numbered(scratch.table(tops, "tops"), [], ["tree"], scratch)
        members = placed.select(F.lit("").alias("tree"), "pos", "n", "digest", F.col("tree").alias("member"))
        return _prove(members, alone, scratch, levels).select(F.col("member").alias("tree"), "above", F.col("digest").alias("subroot"), "root")

    proven = _prove(numbered(leaves, ["tree"], ["doc_id", "digest"], scratch), sources, scratch, levels)
    return scratch.last(proven.select("doc_id", "source", F.col("digest").alias("leaf"), "tampered", "above", "subroot", "root"), "manifest")


def fold(leaf: Column, above: Column) -> Column:
    """The root that a leaf and the digests beside its path lead to."""
    return F.aggregate(above, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verify(manifest: DataFrame) -> DataFrame:
    """The contract's columns: every proof folded from what is found now."""
    beside = F.array_join(F.transform("above", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("above"))
    out = manifest.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]) + ")"

#: DuckDB SQL of the contract's columns.
SQL = f"""
WITH RECURSIVE
d AS (SELECT *, row_number() OVER () AS rid FROM documents),
h AS (SELECT rid, doc_id, coalesce('=' || source, '') AS tree, {_LEAF("text")} AS leaf,
        CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} END AS tampered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
s AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY tree, level, pos // 3),
tops AS (SELECT tree, level, digest FROM s WHERE n = 1),
r AS (SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT digest AS root FROM r WHERE n = 1),
places AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, level AS top, digest AS subroot FROM tops),
beside_s AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM s a JOIN s b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
beside_r AS (SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM r a JOIN r b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.pos),
steps AS (
  SELECT p.rid, x.level AS step, x.l, x.r FROM p JOIN beside_s x ON x.tree = p.tree AND x.pos = p.pos // CAST(pow(3, x.level) AS BIGINT)
  UNION ALL
  SELECT p.rid, q.top + x.level, x.l, x.r FROM p JOIN places q USING (tree) JOIN beside_r x ON x.pos = q.place // CAST(pow(3, x.level) AS BIGINT)),
f AS (SELECT rid, 0 AS step, coalesce(tampered, leaf) AS digest FROM p
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(steps.l || f.digest || steps.r) FROM f JOIN steps ON steps.rid = f.rid AND steps.step = f.step),
folded AS (SELECT rid, arg_max(digest, step) AS folded_root FROM f GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, q.subroot, root.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, folded.folded_root, folded.folded_root = root.root AS verified
FROM p JOIN places q USING (tree) JOIN folded USING (rid) LEFT JOIN proof USING (rid) CROSS JOIN root
"""
