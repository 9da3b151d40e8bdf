"""Retrieval queries with their SQL: conditions, as-of search, detail, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import blockmax as bm
from tidemark.operators import documents as dc
from tidemark.operators import retrieval as rt
from tidemark.plans.documents import _BM, _tok, _vis
from tidemark.schema import DOCS_SQL, doc_versions, table
from tidemark.sources.sinks import shared_path

c = F.col
AT = "2024-01-10 00:00:00"
QUERIES_ASKED = {1: "light of the river", 2: "th and of", 3: "zzz none", 4: "is this in that"}
NAMES = {"K1": "and of", "K2": "THAT", "K3": "river"}
K, MIN_SCORE, GROUP = 5, 0.05, 0.5


def _at():
    return F.lit(AT).cast("timestamp_ntz")


def _visible(spark, d):
    return dc.visible_at(doc_versions(spark, d), _at())


def _asked(spark):
    q = spark.createDataFrame(sorted(QUERIES_ASKED.items()), "query_id long, text string")
    return q.select("query_id", F.explode(F.array_distinct(tx.tokenize(rt.folded(c("text"))))).alias("token"))


def _found(spark, d, group):
    """Versions visible at a time are indexed with all others, which must not count."""
    docs = doc_versions(spark, d).select((c("doc_id") * 1000 + c("version")).alias("row"), "doc_id", "version", "title", "available_at", "first_seen_at")
    index = dc.postings(docs, "row", "title")
    seen = dc.visible_at(docs, _at()).select(c("row").alias("doc_id"), "version", "title")
    seen = seen.withColumns({"len": F.size(tx.tokenize(c("title"))), "title_tokens": F.array_distinct(tx.tokenize(F.substring_index("title", " ", 4)))})
    return rt.search(index, seen, _asked(spark), rt.eligible(seen, QUERIES_ASKED, "doc_id", ["title"]), K, MIN_SCORE, group)


def search_as_of(spark, d):
    return _found(spark, d, None).select("query_id", "rank", (F.floor(c("doc_id") / 1000)).alias("doc_id"), "version", "score")


def search_grouped(spark, d):
    f = _found(spark, d, GROUP)
    return f.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


def complete_conditions(spark, d):
    """Documents whose text has every word of a query as a whole condition."""
    return rt.eligible(table(spark, d, "documents"), {1: "of the"}, "doc_id", ["text"]).select("doc_id")


def name_mentions(spark, d):
    """Versions linked to a key by code, or that mention its name."""
    v = _visible(spark, d).withColumn("codes", F.when(c("doc_id") % 6 == 0, F.array(F.lit("K3"), F.lit("K9"))).otherwise(F.array().cast("array<string>")))
    m = rt.key_matches(v, NAMES)
    return m.select("doc_id", "version", F.array_join("linked", ",").alias("linked"), F.array_join(F.transform("mentions", lambda x: x["code"]), ",").alias("mentions"))


def abstention(spark, d):
    q = spark.createDataFrame([(k, k != 3) for k in QUERIES_ASKED], "query_id long, has_answer boolean")
    return rt.abstention(q, _found(spark, d, None))


def nearest_rank(spark, d):
    return rt.nearest_rank(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", (0.5, 0.95))


def unique_clusters(spark, d):
    """Different events among each query's hits; hits without one count for themselves."""
    f = _found(spark, d, None)
    cluster = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("e"), (c("doc_id") % 3).cast("string"))).otherwise(c("doc_id").cast("string"))
    return f.groupBy("query_id").agg(F.count_distinct(cluster).alias("clusters"))


def _linked(spark, d):
    v = doc_versions(spark, d)
    return v.withColumns({"amends": F.when(c("doc_id") % 4 == 0, c("doc_id") + 1), "license": F.when(c("doc_id") % 3 == 0, "full_text").otherwise("metadata_only"), "summary": F.substring("title", 1, 20)})


def document_detail(spark, d):
    return rt.detail(_linked(spark, d), _at())


def amended_by(spark, d):
    """Visible documents and those that seem to amend them: a join with itself."""
    v = dc.visible_at(_linked(spark, d), _at()).select("doc_id", "amends")
    return v.alias("a").join(v.alias("b"), c("b.amends") == c("a.doc_id")).select(c("a.doc_id").alias("doc_id"), c("b.doc_id").alias("amended_by"))


def archive_page(spark, d):
    """Third page of three rows of what was published in a period, with status."""
    v = _visible(spark, d).where(F.to_date("available_at").between(F.lit("2024-01-02"), F.lit("2024-01-08")) & (c("version") > 1))
    return v.orderBy(c("available_at").desc(), c("doc_id").desc()).offset(6).limit(3).select("doc_id", "version", F.date_format("available_at", "yyyy-MM-dd").alias("day"))


def status_facets(spark, d):
    """How many visible documents have each status, before any filter."""
    v = dc.visible_at(_linked(spark, d), _at())
    flags = dc.quality_flags({"amendment": c("amends").isNotNull(), "revised": c("version") > 1, "unlinked": c("license") == "metadata_only"})
    return v.select(F.explode(flags).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def keyset_page(spark, d):
    """The rows after a key, in key order: a page without an offset."""
    newest = Window.partitionBy("o_custkey").orderBy(c("o_orderdate").desc(), c("o_orderkey").desc())
    o = table(spark, d, "orders").withColumn("k", F.row_number().over(newest)).where("k = 1")
    return o.where("o_orderkey > 500").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_custkey")


def current_records(spark, d):
    """A view of versions joined with the number of the current one."""
    v = doc_versions(spark, d)
    current = v.groupBy("doc_id").agg(F.max("version").alias("version"))
    return v.join(current, ["doc_id", "version"]).select("doc_id", "version", "source")


def unknown_numbers(spark, d):
    """Numbers in order notes that the order's facts do not bear out."""
    o = table(spark, d, "orders")
    note = F.concat(F.lit("total "), F.format_number(c("o_totalprice") + F.when(c("o_orderkey") % 10 == 0, 3).otherwise(0), 1), F.lit(", 3 items, key "), c("o_orderkey").cast("string"))
    strange = rt.unknown_numbers(note, F.array("o_totalprice", c("o_orderkey").cast("double")))
    return o.select("o_orderkey", F.size(strange).alias("unknown")).where("unknown > 0")


def stored_topk(spark, d):
    """The five best documents of each benchmark text, by an index on disk that is read in part."""
    index = bm.Index.of(table(spark, d, "documents"), shared_path(spark, "index"))
    queries = table(spark, d, "benchmark").select(c("item_id").alias("query_id"), F.explode(F.array_distinct(bm.tokens_of(c("text")))).alias("token"))
    return index.search(queries, 5)[0]


QUERIES = {
    f.__name__: f
    for f in (stored_topk, search_as_of, search_grouped, complete_conditions, name_mentions, abstention, nearest_rank, unique_clusters, document_detail, amended_by, archive_page, status_facets, keyset_page, current_records, unknown_numbers)
}

_FOLD = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z가-힣]+', ' ', 'g')"
_HAS = lambda x, w: f"regexp_matches({x}, '(^|[^0-9a-z]){w}([^0-9a-z]|$)')"
_ALL = " UNION ALL ".join(f"SELECT {k} AS query_id, rid FROM seen WHERE {' AND '.join(_HAS('f', w) for w in q.split())}" for k, q in QUERIES_ASKED.items())
_TOKENS = ", ".join(f"({k}, '{w}')" for k, q in QUERIES_ASKED.items() for w in dict.fromkeys(q.split()))
_FOUND = f"""{DOCS_SQL}, {_vis('observed')}, seen AS (SELECT doc_id * 1000 + version AS rid, doc_id, version, title, {_FOLD('title')} AS f, {_tok('title')} AS t FROM vis),
st AS (SELECT count(*) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM seen), po AS (SELECT rid, token, count(*) AS tf, any_value(l) AS l FROM (SELECT rid, len(t) AS l, unnest(t) AS token FROM seen) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM po GROUP BY 1), qu(query_id, token) AS (VALUES {_TOKENS}), el AS ({_ALL}),
sc AS (SELECT query_id, rid, round(CAST(sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / avgdl)), 9) AS DECIMAL(18,9))) AS DOUBLE), 6) AS score FROM qu JOIN po USING (token) JOIN df USING (token), st GROUP BY 1, 2),
sx AS (SELECT sc.* FROM sc JOIN el ON el.query_id = sc.query_id AND el.rid = sc.rid), sm AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sx),
rk AS (SELECT query_id, rid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rid) AS rank FROM sm WHERE best > {MIN_SCORE})"""
_LINKED = f"lk AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 END AS amends, CASE WHEN doc_id % 3 = 0 THEN 'full_text' ELSE 'metadata_only' END AS license FROM vis)"
_SHORT = "list_distinct(regexp_extract_all(lower(array_to_string(string_split(title, ' ')[1:4], ' ')), '[0-9a-z]+'))"

SQL = {
    "stored_topk": f"WITH {_BM} SELECT query_id, rank, doc_id, score FROM rk WHERE rank <= 5",
    "search_as_of": f"WITH {_FOUND} SELECT query_id, rank, rid // 1000 AS doc_id, rid % 1000 AS version, score FROM rk WHERE rank <= {K}",
    "complete_conditions": f"WITH t AS (SELECT doc_id, {_FOLD('text')} AS f FROM documents) SELECT doc_id FROM t WHERE {_HAS('f', 'of')} AND {_HAS('f', 'the')}",
    "name_mentions": f"""WITH {DOCS_SQL}, {_vis('observed')}, f AS (SELECT *, {_FOLD('title')} AS f FROM vis), m AS (SELECT doc_id, version, CASE WHEN doc_id % 6 = 0 THEN 'K3' ELSE '' END AS linked,
 array_to_string(list_filter([CASE WHEN {_HAS('f', 'and *of')} THEN 'K1' END, CASE WHEN {_HAS('f', 'that')} THEN 'K2' END, CASE WHEN {_HAS('f', 'river')} THEN 'K3' END], lambda x: x IS NOT NULL), ',') AS mentions FROM f)
SELECT doc_id, version, linked, coalesce(mentions, '') AS mentions FROM m WHERE linked <> '' OR coalesce(mentions, '') <> ''""",
    "abstention": f"WITH {_FOUND}, q AS (SELECT unnest([{', '.join(map(str, QUERIES_ASKED))}]) AS query_id), s AS (SELECT query_id, query_id NOT IN (SELECT query_id FROM rk) AS silent FROM q) SELECT avg(CAST(silent AS DOUBLE)) FILTER (query_id = 3) AS no_answer_abstain, avg(CAST(silent AS DOUBLE)) FILTER (query_id <> 3) AS false_abstain FROM s",
    "nearest_rank": "SELECT quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders",
    "unique_clusters": f"WITH {_FOUND} SELECT query_id, count(DISTINCT CASE WHEN rid % 2 = 0 THEN 'e' || rid % 3 ELSE CAST(rid AS VARCHAR) END) AS clusters FROM rk WHERE rank <= {K} GROUP BY 1",
    "document_detail": f"""WITH {DOCS_SQL}, {_vis('observed')}, {_LINKED}, n AS (SELECT doc_id, count(*) AS versions FROM docs WHERE available_at <= TIMESTAMP '{AT}' AND first_seen_at <= TIMESTAMP '{AT}' GROUP BY 1)
SELECT lk.doc_id, lk.version, versions, amends, amends IS NOT NULL AND amends IN (SELECT doc_id FROM vis) AS amends_visible, (SELECT count(*) FROM lk b WHERE b.amends = lk.doc_id) AS amended_by, CASE WHEN license = 'full_text' THEN substr(title, 1, 20) END AS summary FROM lk JOIN n USING (doc_id)""",
    "amended_by": f"WITH {DOCS_SQL}, {_vis('observed')}, {_LINKED} SELECT a.doc_id, b.doc_id AS amended_by FROM lk a JOIN lk b ON b.amends = a.doc_id",
    "archive_page": f"WITH {DOCS_SQL}, {_vis('observed')} SELECT doc_id, version, strftime(available_at, '%Y-%m-%d') AS day FROM vis WHERE CAST(available_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-08' AND version > 1 ORDER BY available_at DESC, doc_id DESC LIMIT 3 OFFSET 6",
    "status_facets": f"WITH {DOCS_SQL}, {_vis('observed')}, {_LINKED}, f AS (SELECT 'amendment' AS status, amends IS NOT NULL AS x FROM lk UNION ALL SELECT 'revised', version > 1 FROM lk UNION ALL SELECT 'unlinked', license = 'metadata_only' FROM lk) SELECT status, count(*) AS n FROM f WHERE x GROUP BY 1",
    "keyset_page": "WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_orderkey, o_custkey FROM o WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25",
    "current_records": f"WITH {DOCS_SQL} SELECT doc_id, version, source FROM docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1",
    "unknown_numbers": "SELECT o_orderkey, CAST(1 AS INT) AS unknown FROM orders WHERE o_orderkey % 10 = 0 AND abs(round(o_totalprice + 3, 1) - o_orderkey) > 0.05",
}
