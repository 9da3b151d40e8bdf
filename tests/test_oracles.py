"""Every registered query against its SQL, and the rest for plain sense."""

import pytest
from compare import DATA, connect, same

from tidemark.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), SQL[name], con)


def test_what_has_no_sql():
    """Each of these has a test of its own below."""
    assert set(QUERIES) - set(SQL) == {"title_groups", "mmr", "fc_model", "fc_bands", "search_grouped"}


@pytest.fixture(scope="module")
def ranked(spark):
    from tidemark.plans import documents

    hits = {}
    for r in documents._ranked(spark, DATA, 20).orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append((r["doc_id"], r["rel"], set(r["tokens"])))
    return hits


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_title_groups_against_brute_force(spark, ranked):
    want = set()
    for q, hits in ranked.items():
        leaders = []
        for doc, _, tokens in hits:
            found = next((x for x, t in leaders if likeness(tokens, t) >= 0.3), None)
            if found is None:
                leaders.append((doc, tokens))
            want.add((q, doc, doc if found is None else found))
    got = QUERIES["title_groups"](spark, DATA).collect()
    assert len(got) == len(want) and {(r["query_id"], r["doc_id"], r["leader"]) for r in got} == want


def test_mmr_against_brute_force(spark, ranked):
    want = set()
    for q, hits in ranked.items():
        picked, left = [], list(hits)
        while left and len(picked) < 5:
            best = max(left, key=lambda h: 0.7 * h[1] - 0.3 * max((likeness(h[2], p[2]) for p in picked), default=0.0))
            want.add((q, len(picked), best[0]))
            picked.append(best)
            left.remove(best)
    got = QUERIES["mmr"](spark, DATA).collect()
    assert len(got) == len(want) and {(r["query_id"], r["place"], r["doc_id"]) for r in got} == want


def test_grouped_search_keeps_the_best_of_each_query(spark):
    plain = {(r["query_id"], r["score"]) for r in QUERIES["search_as_of"](spark, DATA).where("rank = 1").collect()}
    grouped = {(r["query_id"], r["best"]) for r in QUERIES["search_grouped"](spark, DATA).collect()}
    assert grouped == plain and plain


def test_model_is_scored_on_every_test_row(spark):
    (r,) = QUERIES["fc_model"](spark, DATA).collect()
    base = {x["split"]: x for x in QUERIES["fc_persistence"](spark, DATA).collect()}["test"]
    assert r["n"] == base["n"]
    assert 0.6 <= r["coverage"] <= 1 and 0 < r["pinball"] < base["pinball"]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
