"""Line-first quality rules, in DataFrame expressions only.

Every line that holds a word is judged by itself: punctuation, navigation and
boilerplate rules remove it or keep it. A document that loses too much of its
text that way, or fails the document-wide base rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
MIN_WORDS = 50
#: Up to so many windows found twice are looked up one by one; more are sorted.
FEW = 64
#: A document goes if its lines that fail hold more than this share of its characters.
MAX_LOST = 0.5

#: Closing punctuation, which a line of under ``OPEN_LINE`` characters must end in.
OPEN_LINE = 120
ENDINGS = ".!?;:,…。！？\"”»’')]"
#: Separators of menus, tables and breadcrumbs; three or more, at more than one
#: for each ``NAVIGATION_GAP`` characters, make a navigation line.
SEPARATORS = "|›»•·"
NAVIGATION_GAP = 20
#: Marks stuck to words; a line with more than one for each ``NOISE_GAP``
#: characters fails.
MARKS = "#*$%&<>!"
NOISE_GAP = 20
#: Site furniture.
BOILERPLATE = r"(?i)(lorem ipsum|javascript (is|must be)|enable (javascript|cookies)|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (in|up)|log ?in|subscribe to|share (this|on)|powered by)"
#: Boilerplate rules hold for lines up to this many characters.
BOILERPLATE_LINE = 200


def _count(line: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(line, f"[^{chars}]+", ""))


def _line_kept(line: Column) -> Column:
    closed = F.substring(F.rtrim(line, F.lit(" \t\n\r\x0b\x0c")), -1, 1).isin(*ENDINGS)
    closed = closed | (F.length(line) >= OPEN_LINE)
    separators = _count(line, SEPARATORS)
    navigation = (separators >= 3) & (NAVIGATION_GAP * separators > F.length(line))
    noise = NOISE_GAP * _count(line, MARKS) > F.length(line)
    furniture = (F.length(line) <= BOILERPLATE_LINE) & line.rlike(BOILERPLATE)
    return closed & ~navigation & ~noise & ~furniture


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        more = F.aggregate(steps, F.lit(0), lambda n, k: n + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(p) > 1, 3 + more).otherwise(0)

    def by_sorting(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(s, k)["i"])

        return F.sort_array(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places))

    def by_lookup(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def of(h: Column) -> Column:
        twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1)))
        many = lambda d: F.when(F.size(d) == 0, 0).otherwise(let(F.when(F.size(d) <= FEW, by_lookup(h, d)).otherwise(by_sorting(h)), covered))
        return let(let(F.sort_array(h), twice), many)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, of))


def quality_column(text: Column) -> Column:
    """Struct of the counts, base_failed, kept and clean_text of a text.

    Null counts as the empty text, which has no word and fails. Windows of
    words are compared by 64-bit hash. clean_text keeps the passing lines.
    """

    def judge(t: Column) -> Column:
        words = F.filter(F.split(t, f"[{SPACE}]+", -1), lambda w: w != "")
        counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        sizes = let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"), F.length(F.array_join(ls, "")).alias("all"), F.filter(ls, _line_kept).alias("good")))

        def collect(c: Column, s: Column) -> Column:
            failed = (c["n"] < MIN_WORDS) | (100 * c["r"] > 50 * c["n"])
            lost = 1 - F.length(F.array_join(s["good"], "")) / F.greatest(s["all"], F.lit(1))
            return F.struct(
                c["n"].cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                s["dup"].cast("long").alias("n_dup_lines"),
                c["r"].cast("long").alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (lost <= MAX_LOST)).alias("kept"),
                F.array_join(s["good"], "\n").alias("clean_text"),
            )

        return let(F.struct(counts.alias("c"), sizes.alias("s")), lambda x: collect(x["c"], x["s"]))

    return let(F.coalesce(text, F.lit("")), judge)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, clean_text), one row per input row.

    Repeated rows and null ids stay. Other columns are not read.
    """
    return docs.select(F.col(id_col), quality_column(F.col(text_col)).alias("quality")).select(id_col, "quality.*")


_MARK = lambda chars: f"length(regexp_replace(x, '[^{chars}]+', '', 'g'))"
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in ENDINGS)

#: DuckDB SQL of the contract's columns.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^{SPACE}]+') AS ws FROM t),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]}})) AS g FROM w WHERE len(ws) >= 4),
h AS (SELECT rid, list(g.i) AS places FROM g GROUP BY rid, g.a, g.b, g.c HAVING count(*) > 1),
p AS (SELECT rid, unnest(places) AS i FROM h),
r AS (SELECT rid, count(DISTINCT i + d) AS n FROM p, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM t),
m AS (SELECT rid, ls, list_filter(ls, lambda x: (length(x) >= {OPEN_LINE} OR right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ({_ENDS}))
        AND NOT ({_MARK(SEPARATORS)} >= 3 AND {NAVIGATION_GAP} * {_MARK(SEPARATORS)} > length(x))
        AND NOT {NOISE_GAP} * {_MARK(MARKS)} > length(x)
        AND NOT (length(x) <= {BOILERPLATE_LINE} AND regexp_matches(x, '{BOILERPLATE}'))) AS good FROM l),
c AS (SELECT t.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        length(array_to_string(good, '')) AS good_chars, greatest(length(array_to_string(ls, '')), 1) AS all_chars
      FROM t JOIN w USING (rid) JOIN m USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 - good_chars / all_chars <= {MAX_LOST} AS kept
FROM b
"""
