"""Keyed state with timers, and the source of delivered pages, over restarts."""

import json
from datetime import date, datetime, timedelta

import pytest

from tidemark.sources.commits import CommitLog
from tidemark.streaming import observed, pages


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*observed.STATE_STORE)
    yield
    spark.conf.unset(observed.STATE_STORE[0])


def day(d, hour=12):
    return datetime(2024, 1, d, hour)


class Feed:
    def __init__(self, spark, top, known=None):
        self.spark, self.top, self.known = spark, str(top), known

    def add(self, *rows):
        self.spark.createDataFrame(rows, "doc_id long, title string, published date, observed timestamp").coalesce(1).write.mode("append").parquet(f"{self.top}/in")

    def run(self):
        rows = self.spark.readStream.schema("doc_id long, title string, published date, observed timestamp").parquet(f"{self.top}/in")
        out = observed.observe(rows, timedelta(days=3), known=self.known)
        out.writeStream.format("parquet").option("path", f"{self.top}/out").option("checkpointLocation", f"{self.top}/check").trigger(availableNow=True).start().awaitTermination()
        got = self.spark.read.schema(observed.OUT).parquet(f"{self.top}/out").collect()
        return sorted((r["doc_id"], r["observed"], r["kind"], r["version"], r["available"], r["forms"]) for r in got)


def test_versions_late_rows_and_closing(spark, tmp_path):
    """State lives over restarts; a late row is available at the midnight after
    its publication; a quiet document is closed and starts anew."""
    feed = Feed(spark, tmp_path)
    feed.add((1, "a", date(2024, 1, 2), day(2)), (1, "a", date(2024, 1, 2), day(2, 13)), (2, "x", date(2024, 1, 1), day(2)), (None, "n", None, day(2)), (3, None, None, day(2)))
    first = feed.run()
    assert first == [(1, day(2), "new", 1, day(2), None), (1, day(2, 13), "duplicate", 1, day(2), None), (2, day(2), "new", 1, day(2, 0), None)]
    feed.add((1, "b", date(2024, 1, 2), day(4)), (2, "x", date(2024, 1, 1), day(4)))
    second = feed.run()
    assert sorted(set(second) - set(first)) == [(1, day(4), "changed", 2, day(3, 0), None), (2, day(4), "duplicate", 1, day(2, 0), None)]
    feed.add((2, "y", date(2024, 1, 9), day(9)))
    third = set(feed.run()) - set(second)
    assert (1, day(4), "closed", 2, day(3, 0), 2) in third
    feed.add((1, "c", date(2024, 1, 9), day(9, 13)))
    assert (1, day(9, 13), "new", 1, day(9, 13), None) in feed.run()


def test_state_starts_with_a_stored_table(spark, tmp_path):
    known = spark.createDataFrame([(1, 4, observed_hash("a"), day(1), day(1)), (5, 2, observed_hash("q"), day(1), day(1))], "doc_id long, version long, hash string, observed timestamp, available timestamp")
    feed = Feed(spark, tmp_path, known)
    feed.add((1, "a", date(2024, 1, 2), day(2)), (1, "b", date(2024, 1, 2), day(3)))
    assert feed.run()[:2] == [(1, day(2), "duplicate", 4, day(1), None), (1, day(3), "changed", 5, day(3, 0), None)]
    feed.add((1, "b", date(2024, 1, 9), day(9)))
    assert (5, day(1), "closed", 2, day(1), 1) in feed.run()


def observed_hash(title):
    import hashlib

    return hashlib.sha256(title.encode()).hexdigest()[:16]


def test_a_bad_page_keeps_the_last_good_table(spark, tmp_path):
    folder, store = tmp_path / "pages", str(tmp_path / "store")
    folder.mkdir()

    def deliver(name, items, total=None):
        (folder / name).write_text(json.dumps({"total": str(len(items) if total is None else total), "items": items}))

    def table():
        return sorted((r["page"], r["place"], r["id"], r["title"]) for r in CommitLog(spark, f"{store}/rows").read().collect())

    deliver("p1.json", [{"id": 1, "title": "a"}, {"id": "2", "title": None}])
    assert pages.refresh(spark, str(folder), store)["status"] == "ok"
    good = [("p1.json", 0, 1, "a"), ("p1.json", 1, 2, None)]
    assert table() == good
    (folder / "p2.json").write_text('{"total": "1", "items": [{"id"')
    deliver("p3.json", [{"id": 3, "title": "c"}])
    for _ in range(2):
        state = pages.refresh(spark, str(folder), store)
        assert (state["status"], state["number"]) == ("stale", 1) and state["error"].startswith("p2.json")
        assert table() == good
    deliver("p2.json", [{"id": 9, "title": "b"}], total=2)
    assert pages.refresh(spark, str(folder), store)["error"] == "p2.json: states 2 items, has 1"
    deliver("p2.json", [{"id": 9, "title": "b"}])
    assert pages.refresh(spark, str(folder), store) == {"status": "ok", "number": 2, "error": None}
    want = [*good, ("p2.json", 0, 9, "b"), ("p3.json", 0, 3, "c")]
    assert table() == want
    assert pages.refresh(spark, str(folder), store)["status"] == "ok" and table() == want


@pytest.mark.parametrize("body", ["", "[]", "{}", '{"total": 1, "items": 3}', '{"total": 1, "items": [{"title": "x"}]}', '{"total": "x", "items": []}', "null"])
def test_faults_of_a_page(body):
    with pytest.raises(pages.BadPage):
        pages.items_of("p", body.encode())




def test_many_pages_are_few_tasks(spark, tmp_path):
    folder, store = str(tmp_path / "pages"), str(tmp_path / "store")
    rows = [(f"p{k:05d}", 1, [(k, None if k % 2 else f"t{k}")]) for k in range(600)]
    delivered = spark.createDataFrame(rows, "name string, total long, items array<struct<id: long, title: string>>")
    pages.deliver(delivered.where("name < 'p00300'"), folder)
    pages.deliver(delivered, folder)  # replaces the first ones
    assert sorted(p.name for p in (tmp_path / "pages").iterdir() if p.name[0] not in "._") == [f"p{k:05d}.json" for k in range(600)]
    parts = pages.PageReader(folder).partitions({"after": ""}, {"after": "p00598.json"})
    assert len(parts) == -(-599 // pages.TOGETHER) and sum(len(list(pages.PageReader(folder).read(p))) for p in parts) == 599
    assert pages.refresh(spark, folder, store)["status"] == "ok"
    got = CommitLog(spark, f"{store}/rows").read().orderBy("id").collect()
    assert [(r["page"], r["place"], r["id"], r["title"]) for r in got] == [(f"p{k:05d}.json", 0, k, None if k % 2 else f"t{k}") for k in range(600)]
