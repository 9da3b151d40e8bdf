"""Readers of bars, minutes, documents and feeds with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.commits import CommitLog

c = F.col

PRICES = "date date, ticker string, open double, high double, low double, close double, volume double, value double"
MARKETCAP = "date date, ticker string, marketcap bigint, shares bigint, market string"
MASTER = "ticker string, name string, market string, sector string, listing_date date, kind string, is_delisted boolean"
MINUTES = "code string, dt timestamp_ntz, open_p int, high_p int, low_p int, close_p int, volume bigint, value bigint"
DOCUMENTS = """doc_id string, version bigint, source string, source_type string, title string, summary string, url string, published_at string,
 first_seen_at string, available_at string, tickers array<struct<code:string,method:string,evidence:string,confidence:double>>, status string"""


def positive_or_null(x: Column) -> Column:
    """Prices that are not above zero are missing."""
    return F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0))


def daily_bars(spark: SparkSession, store: str, tickers: list[str] | None = None, end: str | None = None) -> DataFrame:
    """Daily bars with market value and master data; filters reach the scans.

    A row whose stored open is missing is halted; prices that are not above
    zero become missing without that. The master is joined as Spark sees fit:
    broadcast while it is small.
    """
    prices = spark.read.schema(PRICES).parquet(f"{store}/prices.parquet")
    caps = spark.read.schema(MARKETCAP).parquet(f"{store}/marketcap.parquet")
    master = spark.read.schema(MASTER).parquet(f"{store}/master.parquet").select("ticker", "kind", "is_delisted")
    if tickers is not None:
        prices = prices.where(c("ticker").isin(tickers))
    if end is not None:
        prices = prices.where(c("date") <= F.lit(end).cast("date"))
    df = prices.join(caps, ["date", "ticker"], "left").join(master, "ticker", "left")
    clean = {x: positive_or_null(c(x)) for x in ("open", "high", "low")}
    return df.withColumns(clean | {"halted": c("open").isNull()})


def minutes(spark: SparkSession, path: str, codes: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Minute rows of a store partitioned by month; months outside are not read."""
    df = spark.read.schema(MINUTES + ", ym string").parquet(path)
    if codes is not None:
        df = df.where(c("code").isin(codes))
    if start is not None:
        df = df.where((c("dt") >= F.lit(start).cast("timestamp_ntz")) & (c("ym") >= start[:7].replace("-", "")))
    if end is not None:
        df = df.where((c("dt") <= F.lit(end).cast("timestamp_ntz")) & (c("ym") <= end[:7].replace("-", "")))
    return df


def minutes_from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated minute rows with their month, ready to be partitioned."""
    return spark.read.schema(MINUTES).option("sep", "\t").option("mode", "FAILFAST").csv(path).withColumn("ym", F.date_format("dt", "yyyyMM"))


def manifest_faults(rows: DataFrame, manifest: dict[str, int]) -> DataFrame:
    """(ym, rows, stated) where a store and its manifest differ."""
    there = rows.groupBy("ym").agg(F.count("*").alias("rows"))
    stated = rows.sparkSession.createDataFrame(sorted(manifest.items()), "ym string, stated long")
    return there.join(stated, "ym", "full").where(~c("rows").eqNullSafe(c("stated")))


def documents(spark: SparkSession, store: str) -> DataFrame:
    """Committed document versions; unfinished files are not seen."""
    return spark.read.schema(DOCUMENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(store)


def decode_search_page(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of JSON result pages; rows without title or link are left out."""
    kind = "struct<total:string,items:array<struct<title:string,link:string,description:string,pubDate:string>>>"
    items = bodies.select(F.inline(F.from_json(c(body), kind)["items"]))
    return items.where("title is not null and link is not null").withColumn("published_at", publisher_time(c("pubDate")))


_FEED = """struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string>>>,
 entry:array<struct<title:string,link:array<struct<_href:string>>,updated:string>>>"""


def decode_feed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS 2.0 or Atom documents as (title, link, published).

    The fields of an item come from that item; what it lacks is NULL.
    """
    feed = bodies.select(F.from_xml(c(body), _FEED).alias("f"))
    rss = F.transform(F.coalesce("f.channel.item", F.array()), lambda x: F.struct(x["title"].alias("title"), x["link"].alias("link"), x["pubDate"].alias("published")))
    atom = F.transform(F.coalesce("f.entry", F.array()), lambda x: F.struct(x["title"].alias("title"), F.get(x["link"], F.lit(0))["_href"].alias("link"), x["updated"].alias("published")))
    return feed.select(F.inline(F.concat(rss, atom)))


def publisher_time(text: Column) -> Column:
    """RFC 2822 or ISO time with an offset; NULL for anything else."""
    mail = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*([+-]\d\d:?\d\d|Z)$"), F.try_to_timestamp(text))
    return F.coalesce(mail, iso)



RAW_DAILY = "date date, ticker string, name string, market string, dept string, open_raw double, high_raw double, low_raw double, close_raw double, volume_raw double, value double, marketcap bigint, shares bigint"
INDEX = "date date, index string, open double, high double, low double, close double, volume double"
SECTOR = "date date, ticker string, sector string"
COVERAGE = "seq bigint, source string, day string, corp_cls string, state string, run_id string, observed_at string"


def raw_daily(spark: SparkSession, store: str, tickers: list[str] | None = None) -> DataFrame:
    """Unadjusted daily rows of all day files."""
    df = spark.read.schema(RAW_DAILY).parquet(f"{store}/raw/krx_daily")
    return df if tickers is None else df.where(c("ticker").isin(tickers))


def index_bars(spark: SparkSession, store: str, end: str | None = None) -> DataFrame:
    df = spark.read.schema(INDEX).parquet(f"{store}/index.parquet").withColumnRenamed("index", "market")
    return df if end is None else df.where(c("date") <= F.lit(end).cast("date"))


def sector_snapshots(spark: SparkSession, store: str) -> DataFrame:
    """Month-end labels, one file a snapshot."""
    return spark.read.schema(SECTOR).option("pathGlobFilter", "*.parquet").parquet(f"{store}/raw/sector")


def optional(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table that may not be there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def coverage_log(spark: SparkSession, store: str, number: int | None = None) -> DataFrame:
    """Logged states as of a commit, the newest if none is named."""
    rows = CommitLog(spark, f"{store}/coverage").read(number)
    return spark.createDataFrame([], COVERAGE) if rows is None else rows


def predictions(spark: SparkSession, run: str, code: str | None = None) -> DataFrame:
    """Predictions of a run; the key reaches the scan."""
    df = spark.read.parquet(f"{run}/predictions.parquet")
    return df if code is None else df.where(c("code") == code)


def footer_range(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(first, last) of a number, date or time, from the footers of Parquet files.

    Executors read the footers; no column is read unless some file has no
    statistics of it or cannot be opened outside Spark. NULL where there is no value.
    """
    rows = spark.read.parquet(path)
    kind = rows.schema[column].dataType
    by_column = rows.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    if not isinstance(kind, (T.IntegralType, T.DateType, T.TimestampNTZType)):
        return by_column

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_footer(p, column) for p in batch["path"]]
            yield pd.DataFrame({"known": [f is not None for f in found], **{k: pd.Series([f and f[k] for f in found], dtype=object) for k in ("first", "last")}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    footers = files.mapInPandas(read, f"known boolean, first {kind.simpleString()}, last {kind.simpleString()}")
    ends = footers.agg(F.coalesce(F.bool_and("known"), F.lit(False)).alias("known"), F.min("first").alias("first"), F.max("last").alias("last")).first()  # one row
    if not ends["known"]:
        return by_column
    return spark.createDataFrame([(ends["first"], ends["last"])], T.StructType([T.StructField(k, kind) for k in ("first", "last")]))


def _footer(path: str, column: str) -> dict | None:
    """Ends of a column in one file; None if its footer does not tell them."""
    try:
        where, name = opened(path)
        with where.open_input_file(name) as file:
            meta = pq.read_metadata(file)
    except (OSError, ValueError):
        return None
    ends = []
    for g in range(meta.num_row_groups):
        chunks = [meta.row_group(g).column(k) for k in range(meta.num_columns)]
        stats = next((x.statistics for x in chunks if x.path_in_schema == column), None)
        if stats is not None and stats.has_min_max:
            ends += [stats.min, stats.max]
        elif stats is None or not stats.has_null_count or stats.null_count < meta.row_group(g).num_rows:
            return None
    return {"first": min(ends, default=None), "last": max(ends, default=None)}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; ``file:/x`` is how Hadoop writes local ones."""
    local = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri(path.removeprefix("file:") if local else path)


def as_of_range(spark: SparkSession, run: str) -> DataFrame:
    """First and last time of a run, a single row, from the footers of its files."""
    return footer_range(spark, f"{run}/predictions.parquet", "as_of")


def dump_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(values) of the rows that a SQL dump inserts into one table.

    Statements are the records of the scan, so each is read by itself. It has
    to have its values one tuple a line, after a line that ends in VALUES, with
    quotes inside texts doubled; one laid out otherwise (tuples on the first line, line
    ends or backslashes inside texts, a text that holds INSERT INTO) ends the
    job with an error, as its rows would come out wrong.
    """
    statements = spark.read.option("lineSep", "INSERT INTO ").text(path).where(c("value").startswith(f"`{table}`"))
    whole = r"^\((?:[^'\\]|'(?:[^'\\]|'')*')*\)[,;]\s*$"
    lines = statements.select(F.split("value", "\n").alias("lines"))
    last = F.array_position(F.transform("lines", lambda x: x.rlike(r";\s*$")), F.lit(True)).cast("int")
    tuples = F.slice("lines", 2, F.greatest(last - 1, F.lit(0)))
    header = F.get("lines", F.lit(0))
    fine = header.rlike(r"^`[^`]+`[^']*\bVALUES\s*$") & (last > 1) & F.forall(tuples, lambda x: x.rlike(whole))
    refused = F.raise_error(F.concat(F.lit("cannot read this layout of a dump: "), F.substring(header, 1, 80))).cast("array<string>")
    rows = lines.select(F.explode(F.when(fine, tuples).otherwise(refused)).alias("line"))
    inner = F.regexp_extract("line", r"^\((.*)\)[,;]\s*$", 1)
    value = lambda v: F.when(v.startswith("'"), F.replace(F.regexp_replace(v, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.nullif(v, F.lit("NULL")))
    return rows.select(F.transform(F.split(inner, ",(?=(?:[^']*'[^']*')*[^']*$)"), lambda v: value(F.trim(v))).alias("values"))


def verified_snapshot(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, fault) for every source whose rows are not those that the
    manifest states: their number, uniqueness of (doc_id, version), and hashes."""
    there = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "version").alias("keys"), F.count_if(~c("record_sha256").eqNullSafe(F.sha2("document", 256))).alias("wrong"))
    both = manifest.select("source", "document_versions").join(there, "source", "full")
    fault = F.when(c("document_versions").isNull(), "unknown_source").when(c("n").isNull(), "missing_source").when(c("n") != c("document_versions"), "count").when(c("keys") < c("n"), "repeated_key").when(c("wrong") > 0, "hash")
    return both.select("source", fault.alias("fault")).where("fault is not null")
