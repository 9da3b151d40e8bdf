"""As-of retrieval: complete conditions, name mentions, grouped search, detail."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import nfkc
from tidemark.operators import documents as dc
from tidemark.operators import phrases

c = F.col


def folded(text: Column) -> Column:
    """Compatibility form, lower case, everything but words as one space.

    ASCII texts, most of a corpus, need no normal form.
    """
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), nfkc(text)).otherwise(text)), f"[^{phrases.WORD}]+", " ")


def eligible(docs: DataFrame, queries: dict[int, str], id_col: str, fields: list[str]) -> DataFrame:
    """(query_id, doc_id): documents that meet every word of a query, found in one pass for all queries."""
    met = phrases.queries_met(docs.sparkSession, [c(f) for f in fields], queries)
    return docs.select(F.explode(met).alias("query_id"), c(id_col).alias("doc_id"))


def key_matches(docs: DataFrame, names: dict[str, str], codes: str = "codes", fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """Documents linked to one of the keys, or that mention a name, with both kinds of evidence.

    ``names`` may be many thousands: one automaton finds them all, and keys and
    names are looked up in a table by number, so the plan does not grow.
    """
    spark, keys = docs.sparkSession, sorted(names)
    known = [(k, p) for k, key in enumerate(keys) if (p := phrases.name(names[key])) is not None]
    find = phrases.finder(spark, phrases.Dictionary(known))
    sent = spark.sparkContext.broadcast({"keys": keys, "names": [names[k] for k in keys], "all": set(keys)})

    @F.pandas_udf("array<struct<code:string,name:string,field:string>>")
    def evidence(*found: pd.Series) -> pd.Series:
        told = sent.value
        return pd.Series([_told(told, fields, row) for row in zip(*found)])

    @F.pandas_udf("array<string>")
    def linked(given: pd.Series) -> pd.Series:
        wanted = sent.value["all"]
        return given.map(lambda xs: sorted({x for x in xs if x in wanted}) if xs is not None else None)

    df = docs.withColumns({"linked": linked(c(codes)), "mentions": evidence(*(find(c(f)) for f in fields))})
    return df.where((F.size("linked") > 0) | (F.size("mentions") > 0))


def _told(told: dict, fields: tuple[str, ...], row: tuple) -> list[dict]:
    """Evidence of the names found in each field of a row, by key, then field."""
    found = sorted((int(n), k) for k, numbers in enumerate(row) for n in numbers)
    return [{"code": told["keys"][n], "name": told["names"][n], "field": fields[k]} for n, k in found]


def search(index: DataFrame, visible: DataFrame, queries: DataFrame, eligible: DataFrame | None, k: int, min_score: float = 0.0, group: float | None = None, candidates: int = 100) -> DataFrame:
    """(query_id, rank, doc_id, version, score, members): the best hits of each query.

    Statistics are those of the visible documents; ``eligible`` (query_id,
    doc_id) is asked after scoring. A query whose best score is not above
    ``min_score`` finds nothing. With ``group`` similar titles stand behind the
    first of them, among the best ``candidates`` hits; later hits are not grouped. ``visible`` has doc_id, version, len and title_tokens.
    """
    scored = dc.bm25(index, visible, queries)
    if eligible is not None:
        scored = scored.join(eligible, ["query_id", "doc_id"], "left_semi")
    scored = scored.join(visible.select("doc_id", "version", "title_tokens"), "doc_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    scored = scored.withColumn("_best", best).where(c("_best") > min_score).drop("_best")
    order = Window.partitionBy("query_id").orderBy(c("score").desc(), "doc_id", "version")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(c("rank") <= (max(candidates, k) if group is not None else k))
    if group is None:
        return ranked.select("query_id", "rank", "doc_id", "version", "score", F.lit(0).alias("members"))
    asked = queries.groupBy("query_id").agg(F.collect_set("token").alias("asked"))
    bare = ranked.join(asked, "query_id").withColumn("tokens", F.array_except("title_tokens", "asked"))
    groups = dc.group_similar(bare, group)
    sizes = groups.groupBy("query_id", c("leader").alias("doc_id")).agg((F.count("*") - 1).cast("int").alias("members"))
    kept = ranked.drop("rank").join(sizes, ["query_id", "doc_id"])
    return kept.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select("query_id", "rank", "doc_id", "version", "score", "members")


def abstention(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Shares of queries without an answer that found nothing, and with one that
    did. ``queries`` has query_id and has_answer."""
    asked = queries.join(found.select("query_id").distinct().withColumn("_hit", F.lit(True)), "query_id", "left").withColumn("silent", c("_hit").isNull())
    share = lambda cond: F.avg(F.when(cond, c("silent").cast("double")))
    return asked.agg(share(~c("has_answer")).alias("no_answer_abstain"), share(c("has_answer")).alias("false_abstain"))


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """Percentiles that are values: the smallest with at least that share below or at it."""
    return values.agg(*(F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(100 * s)}") for s in shares))


def detail(docs: DataFrame, at: Column, mode: str = "observed") -> DataFrame:
    """What a reader sees of each document at a time: its version, how many
    versions it had, what it amends if that is visible, by how many it is
    amended, and its summary where the licence lets it be shown."""
    now = dc.visible_at(docs, at, mode)
    known = (c("available_at") <= at) & (c("first_seen_at") <= at if mode == "observed" else F.lit(True))
    counts = docs.where(known).groupBy("doc_id").agg(F.count("*").alias("versions"))
    target = now.select(c("doc_id").alias("amends"), F.lit(True).alias("_there"))
    by = now.where("amends is not null").groupBy(c("amends").alias("doc_id")).agg(F.count("*").alias("amended_by"))
    shown = F.when(c("license").isin("summary_link", "full_text"), c("summary"))
    joined = now.join(counts, "doc_id").join(target, "amends", "left").join(by, "doc_id", "left")
    return joined.select("doc_id", "version", "versions", "amends", F.coalesce("_there", F.lit(False)).alias("amends_visible"), F.coalesce("amended_by", F.lit(0)).alias("amended_by"), shown.alias("summary"))


_NUMBER = r"[-−]?\d[\d,]*(?:\.\d+)?"


def unknown_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that no allowed one equals within half its last digit.

    Whole numbers up to ten need no source.
    """

    def strange(token: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(token, ",", ""), "−", "-")
        x = plain.cast("double")
        digits = F.when(F.instr(plain, ".") > 0, F.length(F.substring_index(plain, ".", -1))).otherwise(0)
        tolerance = 0.5 * F.pow(F.lit(10.0), -digits) + 1e-9
        small = (x == F.floor(x)) & (F.abs(x) <= 10)
        return ~small & ~F.exists(allowed, lambda a: (F.abs(x - a) <= tolerance) | (F.abs(F.abs(x) - F.abs(a)) <= tolerance))

    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_NUMBER})"), 1), strange)
