"""License detection by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-case words, joined by spaces. Rules are regular
expressions over that string. A keyword of each rule must be among the words
before its expression runs; the keywords, far fewer than the rules, come first.
Detections overlap; one that lies within another of higher priority (or of the
same priority and longer, or listed earlier) is suppressed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, let

#: Words: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the contract and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: (label, keyword that must be among the words, names as expressions).
FAMILIES = [
    ("mit", "mit", ["mit", "mit x11", "massachusetts institute of technology"]),
    ("apache-2", "apache", ["apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache v2"]),
    ("apache-1.1", "apache", ["apache(?: software)?(?: license)?(?: version)? 1 1"]),
    ("apache-1", "apache", ["apache(?: software)?(?: license)?(?: version)? 1 0"]),
    ("bsd-2", "bsd", ["bsd 2(?: clause)?", "(?:2|two) clause bsd", "simplified bsd"]),
    ("bsd-3", "bsd", ["bsd 3(?: clause)?", "(?:3|three) clause bsd", "(?:new|modified|revised) bsd"]),
    ("bsd-4", "bsd", ["bsd 4(?: clause)?", "(?:4|four) clause bsd", "original bsd"]),
    ("bsd-0", "0bsd", ["0bsd"]),
    ("gpl-1", "gpl", ["gpl ?v?1(?: 0)?(?: only| or later)?"]),
    ("gpl-2", "gpl", ["gpl v?2(?: 0)?(?: only| or later)?"]),
    ("gpl-3", "gpl", ["gpl v?3(?: 0)?(?: only| or later)?"]),
    ("gpl-2", "general", ["gnu general public license(?: as published by the free software foundation)?(?: version)? v?2"]),
    ("gpl-3", "general", ["gnu general public license(?: as published by the free software foundation)?(?: version)? v?3"]),
    ("lgpl-2.1", "lgpl", ["lgpl v?2 1(?: only| or later)?"]),
    ("lgpl-3", "lgpl", ["lgpl v?3(?: 0)?(?: only| or later)?"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license(?: version)? v?2 1"]),
    ("lgpl-3", "lesser", ["gnu lesser general public license(?: version)? v?3"]),
    ("agpl-3", "agpl", ["agpl v?3(?: 0)?(?: only| or later)?"]),
    ("agpl-3", "affero", ["gnu affero general public license(?: version)? v?3"]),
    ("gfdl", "documentation", ["gnu free documentation license"]),
    ("mpl-1.1", "mpl", ["mpl v?1 1"]),
    ("mpl-2", "mpl", ["mpl v?2(?: 0)?"]),
    ("mpl-1.1", "mozilla", ["mozilla public license(?: version)? v?1 1"]),
    ("mpl-2", "mozilla", ["mozilla public license(?: version)? v?2"]),
    ("epl-1", "eclipse", ["eclipse public license(?: version)? v?1"]),
    ("epl-2", "eclipse", ["eclipse public license(?: version)? v?2"]),
    ("eupl", "eupl", ["eupl(?: v?1 [12])?"]),
    ("cddl", "cddl", ["cddl(?: 1 [01])?"]),
    ("isc", "isc", ["isc"]),
    ("zlib", "zlib", ["zlib(?: libpng)?"]),
    ("bsl-1", "boost", ["boost(?: software)?(?: license)?(?: version)? 1(?: 0)?"]),
    ("artistic-2", "artistic", ["artistic(?: license)? 2(?: 0)?"]),
    ("unlicense", "unlicense", ["(?:the )?unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("psf", "python", ["python(?: software foundation)?"]),
    ("php", "php", ["php 3 01?"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("openssl", "openssl", ["openssl"]),
    ("ofl", "font", ["sil open font(?: license)?(?: version)?(?: 1 1)?"]),
    ("odbl", "database", ["open database(?: license)?"]),
    ("ncsa", "ncsa", ["(?:university of illinois )?ncsa"]),
    ("sspl", "sspl", ["sspl(?: 1)?", "server side public license"]),
    ("busl", "business", ["business source license(?: 1 1)?"]),
    ("cecill", "cecill", ["cecill(?: 2 1)?"]),
    ("cc0", "cc0", ["cc0(?: 1 0)?"]),
    ("cc-by", "cc", ["cc by(?: [1-4] [05])?"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1-4] [05])?"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1-4] [05])?"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1-4] [05])?"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1-4] [05])?"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1-4] [05])?"]),
    ("cc-by", "creative", ["creative commons attribution(?: [1-4] [05])?"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike(?: [1-4] [05])?"]),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial(?: [1-4] [05])?"]),
    ("cc-by-nd", "creative", ["creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"]),
]
#: (priority, expression around the name). Every family goes with every frame.
FRAMES = [
    (4, "spdx license identifier {}"),
    (3, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{}(?: licen[cs]e)?"),
    (3, "under (?:the )?(?:terms of the )?{}(?: licen[cs]e)?"),
    (2, "licen[cs]e (?:is )?{}"),
    (2, "{} licen[cs]ed?"),
]
#: (label, keyword, priority, expression): rules that name no family.
GENERAL = [
    ("proprietary", "proprietary", 1, "proprietary licen[cs]e"),
    ("public-domain", "domain", 2, "(?:in|to|into) the public domain"),
    ("copyleft", "copyleft", 1, "copyleft licen[cs]ed?"),
    ("gpl", "gpl", 1, "gpl licen[cs]ed?"),
    ("bsd", "bsd", 1, "bsd(?: style)? licen[cs]ed?"),
    ("cc", "creative", 1, "creative commons licen[cs]e"),
    ("mit", "permission", 4, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 4, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 4, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "redistribute", 4, "you can redistribute it and or modify it under the terms of the gnu general public license"),
]
#: Families whose names stand for the license without a frame.
BARE = ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")
#: What a text must hold for names that can stand without the keyword as a word.
NEEDED = {"massachusetts institute of technology": " massachusetts ", "gpl ?v?1(?: 0)?(?: only| or later)?": " gpl", "server side public license": " server "}
#: Score of a detection by priority; phrases of the contract score 1.
CONFIDENCE = {1: 0.5, 2: 0.7, 3: 0.9, 4: 0.95}

_SPAN = "struct<start:int,stop:int,label:string,priority:int,rule:int>"
#: Put before a detection in the joined string; no word holds it.
_MARK = "\x01"
#: Up to so many detections of a text are compared with one another at once.
FEW = 64


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, expression) in order."""
    out = [(label, word, rank, frame.format(f"(?:{name})")) for (label, word, names), (rank, frame) in product(FAMILIES, FRAMES) for name in names]
    out += [(label, word, 2, name) for label, word, names in FAMILIES if label in BARE and word == "cc" for name in names]
    return out + GENERAL


def _gaps(x: Column) -> Column:
    """Words of a piece of the joined string: each has one space before it."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _spans(joined: Column, label: Column, priority: Column, number: Column, expression: Column) -> Column:
    """Places of an expression as word intervals, in order.

    A mark goes before each match; the place of a mark among the words, less
    the marks before it, is where the match starts.
    """

    def walk(found: Column) -> Column:
        words = F.split(F.regexp_replace(joined, expression, F.lit(f" {_MARK}$0")), F.lit(" "), -1)
        places = F.filter(F.transform(words, lambda w, i: F.when(w == _MARK, i - 1)), lambda i: i.isNotNull())

        def span(at: Column, k: Column) -> Column:
            start = at - k
            return F.struct(start.alias("start"), (start + _gaps(F.get(found, k))).alias("stop"), label.alias("label"), priority.alias("priority"), number.alias("rule"))

        return F.transform(places, span)

    return let(F.regexp_extract_all(joined, expression, 0), lambda found: F.when(F.size(found) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(walk(found)))


def _expression(body: str) -> str:
    return f" (?:{body})(?= )"


def _needed(word: str, body: str) -> str:
    return next((n for name, n in NEEDED.items() if f"(?:{name})" in body), f" {word} ")


def _rule_table() -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(_needed(word, body)).alias("word"), F.lit(rank).alias("priority"), F.lit(n).alias("rule"), F.lit(_expression(body)).alias("expression")) for n, (label, word, rank, body) in enumerate(rules())))


def _survivors(spans: Column) -> Column:
    """Detections that no better one contains, by start.

    What contains a detection starts at most the longest detection's words
    before it, so of many detections only those near one another are compared.
    """

    def covers(g: Column, h: Column) -> Column:
        wider = (g["stop"] - g["start"]) - (h["stop"] - h["start"])
        better = (g["priority"] > h["priority"]) | ((g["priority"] == h["priority"]) & ((wider > 0) | ((wider == 0) & (g["rule"] < h["rule"]))))
        return (g["start"] <= h["start"]) & (g["stop"] >= h["stop"]) & better

    def before(s: Column, x: Column) -> Column:
        """How many of the sorted detections start before x."""

        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            lower = (acc["low"] < acc["high"]) & (F.get(s, middle)["start"] < x)
            return F.struct(F.when(lower, middle + 1).otherwise(acc["low"]).alias("low"), F.when(lower, acc["high"]).otherwise(middle).alias("high"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + 1)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(s).alias("high")), halve)["low"]

    def near(s: Column, longest: Column, h: Column) -> Column:
        ends = F.struct(before(s, h["start"] - longest).alias("low"), before(s, h["start"] + 1).alias("high"))
        return let(ends, lambda e: F.slice(s, e["low"] + 1, e["high"] - e["low"]))

    def many(s: Column) -> Column:
        longest = F.array_max(F.transform(s, lambda g: g["stop"] - g["start"]))
        return let(longest, lambda n: F.filter(s, lambda h: ~F.exists(near(s, n, h), lambda g: covers(g, h))))

    few = lambda s: F.filter(s, lambda h: ~F.exists(s, lambda g: covers(g, h)))
    return let(F.sort_array(spans), lambda s: F.when(F.size(s) <= FEW, few(s)).otherwise(many(s)))


def license_column(text: Column) -> Column:
    """Struct of n_words, base places and detections of a text; null is empty."""
    none = F.array().cast(f"array<{_SPAN}>")

    def detect(joined: Column) -> Column:
        base = F.concat(*(F.when(F.contains(joined, F.lit(f" {phrase} ")), _spans(joined, F.lit(label), F.lit(5), F.lit(-1), F.lit(_expression(phrase)))).otherwise(none) for label, phrase in BASE))
        keywords = F.array(*(F.lit(w) for w in dict.fromkeys(_needed(word, body) for _, word, _, body in rules())))
        run = lambda r: _spans(joined, r["label"], r["priority"], r["rule"], r["expression"])
        hits = lambda seen: F.flatten(F.transform(F.filter(_rule_table(), lambda r: F.array_contains(seen, r["word"])), run))
        found = let(F.filter(keywords, lambda w: F.contains(joined, w)), lambda seen: F.when(F.size(seen) == 0, none).otherwise(let(hits(seen), _survivors)))
        return F.struct(base.alias("base"), found.alias("found"))

    def judge(words: Column) -> Column:
        joined = F.concat(F.lit(" "), ascii_lower(F.array_join(words, " ")), F.lit(" "))
        return let(let(joined, detect), lambda d: F.struct(F.size(words).cast("long").alias("n_words"), d["base"].alias("base"), d["found"].alias("found")))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.regexp_extract_all(t, F.lit(WORD), 0), judge))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, found), one row per input row.

    ``base`` has the places of the fixed phrases, ``found`` the detections of
    the rules that survive. Both hold label, priority, rule and the word
    interval. Null and empty texts have neither. Other columns are not read.
    """
    return docs.select(F.col(id_col), license_column(F.col(text_col)).alias("scan")).select(id_col, "scan.*")


def summary(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan_licenses``."""
    names = lambda spans: F.array_sort(F.array_distinct(spans))
    best = F.array_max(F.transform("found", lambda h: h["priority"]))
    score = F.when(F.size("base") > 0, 1.0).when(best.isNull(), 0.0)
    for rank, value in CONFIDENCE.items():
        score = score.when(best == rank, value)
    return scan.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(names("base.label"), ",").alias("base_labels"),
        F.array_join(names(F.concat("base.label", "found.label")), ",").alias("labels"),
        score.alias("score"),
    )


def _apart(body: str) -> str:
    """The expression over words that each have a space of their own on both
    sides, for engines without look-ahead."""
    return " (?:" + "(?:  )?".join(part.replace(" ", "  ") for part in body.split(" ?")) + ") "


def sql() -> str:
    """DuckDB SQL of the contract's columns, from the same rules."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = [(label, _needed(word, body), rank, n, _apart(body)) for n, (label, word, rank, body) in enumerate(rules())]
    listed += [(label, f" {phrase.split()[-1]} ", 5, -1, _apart(phrase)) for label, phrase in BASE]
    values = ",\n".join(f"({quoted(a)}, {quoted(b)}, {c}, {d}, {quoted(e)})" for a, b, c, d, e in listed)
    best = " ".join(f"WHEN best = {k} THEN {v}" for k, v in CONFIDENCE.items())
    number = "lambda x: (length(x) - length(replace(x, ' ', ''))) // 2"
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return rf"""
WITH rules(label, word, priority, rule, expression) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all({lower}, '{WORD}') AS ws FROM t),
j AS (SELECT rid, ' ' || array_to_string(ws, '  ') || ' ' AS joined FROM w),
h AS (SELECT rid, label, priority, rule, list_transform(regexp_extract_all(joined, expression), {number}) AS m, list_transform(string_split_regex(joined, expression), {number}) AS p
      FROM j JOIN rules ON contains(joined, word)),
k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM h WHERE len(m) > 0),
s AS (SELECT rid, label, priority, rule, CAST(list_sum(p[1:k]) + coalesce(list_sum(m[1:k - 1]), 0) AS BIGINT) AS a, m[k] AS n FROM k),
f AS (SELECT * FROM s WHERE rule < 0 OR NOT EXISTS (SELECT 1 FROM s g WHERE g.rule >= 0 AND g.rid = s.rid AND g.a <= s.a AND g.a + g.n >= s.a + s.n
      AND (g.priority > s.priority OR (g.priority = s.priority AND (g.n > s.n OR (g.n = s.n AND g.rule < s.rule)))))),
d AS (SELECT rid, count(*) FILTER (rule < 0) AS n_base, min(a) FILTER (rule < 0) AS first_word, max(a) FILTER (rule < 0) AS last_word, max(priority) FILTER (rule >= 0) AS best,
      list_sort(list(DISTINCT label) FILTER (rule < 0)) AS b, list_sort(list(DISTINCT label)) AS l FROM f GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 {best} ELSE 0.0 END AS DOUBLE) AS score
FROM w LEFT JOIN d USING (rid)
"""
