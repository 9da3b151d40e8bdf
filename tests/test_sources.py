"""Readers, decoders and writers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators
from tidemark.sources import readers, sinks
from tidemark.streaming import streams


def test_publish_is_whole_or_nothing(spark, tmp_path):
    target = str(tmp_path / "run")
    sinks.publish(spark, target, {"trades": spark.range(3)}, {"a": 1})
    assert spark.read.parquet(f"{target}/trades.parquet").count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark, target, {}, {})
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception):
        sinks.publish(spark, bad, {"x": spark.range(1).select(F.expr("raise_error('no')"))}, {})
    assert sorted(os.listdir(tmp_path)) == ["run"]


def test_minutes_round_trip(spark, tmp_path):
    tsv = tmp_path / "m.tsv"
    tsv.write_text("A\t2024-01-02 09:00:00\t1\t2\t1\t2\t5\t100\nB\t2024-02-02 09:00:00\t1\t2\t1\t2\t5\t100\n")
    store = str(tmp_path / "store")
    sinks.append_months(readers.minutes_from_tsv(spark, str(tsv)), store)
    assert [r["code"] for r in readers.minutes(spark, store, start="2024-02-01").collect()] == ["B"]
    assert readers.minutes(spark, store, codes=["A"], end="2024-01-31").count() == 1
    assert readers.manifest_faults(readers.minutes(spark, store), {"202401": 1, "202402": 2}).collect()[0]["ym"] == "202402"


def test_daily_bars_clean_prices(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    spark.createDataFrame([(day, "A", None, 5.0, -1.0, 4.0, 0.0, 1.0), (day, "B", 2.0, 5.0, 1.0, 4.0, 9.0, 1.0)], readers.PRICES).write.parquet(str(tmp_path / "prices.parquet"))
    spark.createDataFrame([(day, "B", 7, 1, "M")], readers.MARKETCAP).write.parquet(str(tmp_path / "marketcap.parquet"))
    spark.createDataFrame([("B", "n", "M", "s", day, "k", False)], readers.MASTER).write.parquet(str(tmp_path / "master.parquet"))
    a, b = readers.daily_bars(spark, str(tmp_path)).orderBy("ticker").collect()
    assert (a["open"], a["low"], a["halted"], a["marketcap"]) == (None, None, True, None)
    assert (b["open"], b["halted"], b["marketcap"]) == (2.0, False, 7)


def test_decoders(spark):
    body = '{"total": "2", "items": [{"title": "t", "link": "u", "pubDate": "Mon, 1 Jan 2024 09:00:00 +0900"}, {"title": "x"}]}'
    (r,) = readers.decode_search_page(spark.createDataFrame([(body,)], "body string")).collect()
    assert r["title"] == "t" and r["published_at"] == dt.datetime(2024, 1, 1, 0, 0)
    rss = "<rss><channel><item><title>a</title><link>l</link><pubDate>d</pubDate></item><item><title>b</title><link>m</link><pubDate>e</pubDate></item></channel></rss>"
    got = readers.decode_feed(spark.createDataFrame([(rss,)], "body string")).collect()
    assert [(r["title"], r["link"], r["published"]) for r in got] == [("a", "l", "d"), ("b", "m", "e")]


def test_append_new_is_idempotent(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert sinks.append_new(df, path, ["k"]) == 2
    assert sinks.append_new(df, path, ["k"]) == 0
    assert spark.read.parquet(path).count() == 2


def test_stream_restart_reads_only_what_is_new(spark, tmp_path):
    """Two runs on one checkpoint, with a file added between; state lives on."""
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    add = lambda *rows: spark.createDataFrame(rows, "doc_id long, version long, title string").coalesce(1).write.mode("append").parquet(src)

    def once():
        stream = streams.classify_stream(streams.read_stream(spark, src))
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["doc_id"], r["version"], r["kind"]) for r in spark.read.parquet(f"{out}/rows").collect())

    add((1, 1, "a"), (1, 2, "a"), (2, 1, "z"))
    first = once()
    assert first == [(1, 1, "new"), (1, 2, "duplicate"), (2, 1, "new")]
    add((1, 3, "b"), (2, 1, "z"))
    assert once() == sorted([*first, (1, 3, "changed"), (2, 1, "stale")])
    assert once() == sorted([*first, (1, 3, "changed"), (2, 1, "stale")])


def test_presets_and_settings(spark, tmp_path):
    store = sinks.Presets(spark, str(tmp_path / "presets"))
    assert store.read("x") is None and store.write(" Mine ", {"a": 1}) == 1
    assert store.read("mine")["settings"] == {"a": 1}
    assert store.write("MINE", {"a": 2}, 1) == 2
    for bad in (("mine", {}, 1), ("", {}, 0), ("a\tb", {}, 0)):
        with pytest.raises(ValueError):
            store.write(*bad)
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert sinks.merged(base, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3} and base["a"]["b"] == 1


def test_feed_items_keep_their_own_fields(spark):
    rss = "<rss><channel><item><title>a</title></item><item><title>b</title><link>m</link><pubDate>e</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>c</title><link href="n"/></entry></feed>'
    got = readers.decode_feed(spark.createDataFrame([(rss,), (atom,), ("<other/>",)], "body string")).collect()
    assert sorted((r["title"], r["link"], r["published"]) for r in got) == [("a", None, None), ("b", "m", "e"), ("c", "n", None)]


def test_dump_rows_reads_its_layout_and_refuses_others(spark, tmp_path):
    """Nothing is dropped or cut silently."""

    def read(name, sql):
        (tmp_path / name).write_text(sql)
        return [r["values"] for r in readers.dump_rows(spark, str(tmp_path / name), "t").collect()]

    assert read("a.sql", "CREATE;\nINSERT INTO `t` VALUES\n(1,'it''s, so',NULL),\n(2,'NULL',''),\n(3,'a);',5);\nINSERT INTO `u` VALUES (9);\n") == [["1", "it's, so", None], ["2", "NULL", ""], ["3", "a);", "5"]]
    assert read("b.sql", "INSERT INTO `t` (`k`, `v`) VALUES\n(1,2);\nUNLOCK TABLES;\nINSERT INTO `t` VALUES\n(3,4);\n") == [["1", "2"], ["3", "4"]]
    odd = ["(1,2),(3,4);\n", "\n(1,'x\ny');\n", "\n(1,'INSERT INTO `t` VALUES');\n", "\n(1,'it\\'s');\n", "\n(1,2),\n(3,4)\n", "\n(1,2),(3,'a\n);\n"]
    for k, rest in enumerate(odd):
        with pytest.raises(Exception, match="cannot read this layout"):
            read(f"odd{k}.sql", f"INSERT INTO `t` VALUES{rest}")


def test_prepared_table_follows_its_files_and_keeps_its_key(spark, tmp_path):
    """A changed, added or removed file rebuilds; windows of the key need no exchange."""
    at, raw = str(tmp_path / "kept"), tmp_path / "raw"
    rows = spark.range(200).selectExpr("concat('k', id % 7) AS ticker", "id AS date", "double(id) AS close")
    rows.repartition(2).write.parquet(str(raw))
    build = lambda: spark.read.parquet(str(raw))

    def kept(order=("date",)):
        return sinks.prepared(spark, at, {"n": 1}, build, (str(raw),), "ticker", order, 4)

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    assert [kept()[1], kept()[1], kept(("close",))[1]] == [False, True, False]
    sma = lambda df: df.select("ticker", "date", indicators.sma(3).alias("x"))
    assert "Exchange" not in plan(sma(kept()[0])) and "Exchange" in plan(sma(build()))
    assert sorted(sma(kept()[0]).collect()) == sorted(sma(build()).collect())
    # another session knows the files only
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("prepared_")]:
        spark.sql(f"DROP TABLE {name}")
    again, there = kept()
    assert there and "Exchange" not in plan(sma(again)) and again.count() == 200
    part = sorted(raw.glob("*.parquet"))[0]
    os.utime(part, (1, 1))
    assert [kept()[1], kept()[1]] == [False, True]
    rows.limit(1).write.mode("append").parquet(str(raw))
    got, there = kept()
    assert not there and got.count() == 201
    part.unlink()
    got, there = kept()
    held = got.count()
    assert not there and held == build().count() < 201
    # a build that was cut off leaves files without the mark of success
    for mark in (tmp_path / "kept").glob("*/_SUCCESS"):
        mark.unlink()
    again, there = kept()
    assert not there and again.count() == held



def test_range_from_footers(spark, tmp_path):
    """Ends come from footers; files without statistics are read by column."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = str(tmp_path / "r")
    rows = spark.range(100).selectExpr("id", "date'2024-01-01' + int(id) AS day", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) AS at", "cast(null AS bigint) AS none", "string(id) AS text")
    rows.repartition(3).write.parquet(at)
    for column in ("id", "day", "at", "none", "text"):
        want = rows.agg(F.min(column), F.max(column)).first()
        assert tuple(readers.footer_range(spark, at, column).first()) == tuple(want)
    # The last file's footer says nothing; without a look at its column 500 would be missed.
    assert readers._footer(sorted(map(str, (tmp_path / "r").glob("*.parquet")))[0], "id") is not None
    plain = pa.table({"id": pa.array([500], pa.int64())})
    pq.write_table(plain, f"{at}/z.parquet", write_statistics=False)
    assert readers._footer(f"{at}/z.parquet", "id") is None and readers._footer(f"{at}/missing.parquet", "id") is None
    assert readers.footer_range(spark, at, "id").first()["last"] == 500
