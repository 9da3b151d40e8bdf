"""Secret scans: fixed credential shapes plus character Markov models.

Two bigram models score a token: one learnt from random strings, one from
ordinary identifiers and words. Their log-likelihood ratio per character says
which of the two wrote it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start stand.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Runs that may be random strings.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Mean log-likelihood ratio for each character from which a token counts.
THRESHOLD = 0.35

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}

#: Words of which the ordinary samples are made.
ORDINARY_WORDS = """
account action address agent allow amount answer archive array assert async attribute author balance base batch before binary block body border
branch browser buffer build button cache calendar call cancel card catalog category center chain change channel character check child class clear
client close cluster code collect color column command comment commit common compare component config connect constant container content context
control convert copy count create current customer data database date debug decode default delete delivery depth description design detail device
dictionary difference digest direct directory disable display distance document domain download driver dynamic edit element email enable encode
engine entity entry environment error event example exception execute expire export extension factory failure feature field file filter final find
first flag float folder format frame from function gateway generate global graph group handle handler hash header height hidden history host image
import include index information initial input insert instance integer interface internal interval invoice item iterator join keep kernel label
language last layer layout length level library light limit line list listener load local location lock logger login long lookup machine main manager
mapping margin market master match matrix maximum memory merge message method middle minimum mode model module monitor month mouse multiple name
native network node normal notice notification number object offset open operation option order origin output overflow owner package page panel
parameter parent parse partition password path pattern payment percent permission person phone pixel platform player plugin point policy pool popup
position post prefix price print priority private process product profile program project promise property protocol provider public publish query
queue random range rate read record redirect reference region register relation release remote remove render repeat replace report request require
reset resource response result return review role root route rule sample save scale schedule schema scope score screen script scroll search second
section secure select sender sequence series server service session setting shadow share shape signal simple single size slice sort source space
span spring stack start state static station status step stock storage store stream string structure style subject submit subscribe success summary
support switch symbol sync system table target task template temporary terminal test text theme thread ticket time title toggle token toolbar
total trace track transaction transfer transform translate transport tree trigger type unique unit update upload user utility validate value variable
vector vendor verify version video view visible volume wait warning watch weight widget width window with work worker world write yellow zone
""".split()


def labelled_samples(seed: int = 7, n: int = 4000) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), made the same way each time."""
    rng = random.Random(seed)
    sets = [string.ascii_letters + string.digits, ALPHABET, string.ascii_lowercase + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits]
    strange = ["".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))) for _ in range(n)]
    shapes = [
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: "/".join(w),
        lambda w: w[0] + "".join(x.title() for x in w[1:]),
        lambda w: "".join(x.title() for x in w),
        lambda w: "_".join(w).upper(),
        lambda w: "".join(w),
        lambda w: "_".join(w) + f"_{rng.randint(0, 2030)}",
    ]
    usual = [rng.choice(shapes)(rng.choices(ORDINARY_WORDS, k=rng.randint(2, 6))) for _ in range(n)]
    return strange, usual


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio of each character after each, random over ordinary."""

    ratio: tuple[tuple[float, ...], ...]

    def score(self, token: str) -> float:
        """Mean ratio a character; 0 for the empty token."""
        total, last = 0.0, 0
        for c in token:
            code = _CODE.get(c, 0)
            total += self.ratio[last][code]
            last = code
        return total / max(len(token), 1)


def train(strange: list[str], usual: list[str], smooth: float = 0.5) -> MarkovPair:
    """Bigram models with additive smoothing from the two sets of samples."""

    def logs(samples: list[str]) -> np.ndarray:
        n = np.full((len(ALPHABET) + 1,) * 2, smooth)
        for s in samples:
            codes = [0, *(_CODE.get(c, 0) for c in s)]
            np.add.at(n, (codes[:-1], codes[1:]), 1)
        return np.log(n / n.sum(axis=1, keepdims=True))

    return MarkovPair(tuple(map(tuple, (logs(strange) - logs(usual)).tolist())))


@lru_cache(1)
def default_model() -> MarkovPair:
    return train(*labelled_samples())


def find_spans(text: str, model: MarkovPair, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed.

    A random-looking token that lies within a fixed span adds nothing.
    """
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    fixed = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in fixed]
    reach = list(accumulate((e for _, e in fixed), max))  # the last end of spans that start by then
    for m in TOKEN.finditer(text):
        s, e = m.span()
        before = bisect_right(starts, s)
        if before and reach[before - 1] >= e:
            continue
        token = m[0]
        if not token.isdigit() and model.score(token) >= threshold:
            spans.append(("random", s, e))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,stop:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans), one row per input row; null and empty texts have none."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "stop"), s)) for s in find_spans(t or "", model, threshold)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind.upper())]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with secrets in ``text_col`` replaced."""
    model = model or default_model()

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, find_spans(t, model, threshold)))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def summary(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan_secrets``."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan.select(id_col, *counts, F.sha2(_listed(of(*KINDS[:3])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """What ``summary`` gives as base_sha256, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in KINDS[:3]).encode()).hexdigest()


def sql(model: MarkovPair | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the contract's columns, with the model as a table."""
    model = model or default_model()
    chars = ["", *ALPHABET]
    values = ",".join(f"('{a}','{b}',{model.ratio[i][j]!r})" for i, a in enumerate(chars) for j, b in enumerate(chars) if b)
    assign = ASSIGN.pattern.replace("'", "''")

    def spans(kind: int, expression: str, keep: str) -> str:
        return f"""SELECT rid, {kind} AS kind, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a, m[k] AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(text, '{expression}') AS m, string_split_regex(text, '{expression}') AS p FROM t) WHERE len(m) > 0) WHERE {keep}"""

    def listed(where: str) -> str:
        name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
        return f"coalesce(string_agg({name} || ':' || a || ':' || z, ',' ORDER BY a, kind, z){where}, '')"

    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ratio(x, y, r) AS (VALUES {values}),
fx AS (SELECT *, a + length(s) AS z FROM ({spans(0, '(?i)' + assign, f"length(regexp_extract(m[k], '(?i){assign}', 2)) >= 12")}
 UNION ALL {spans(1, ACCESS.pattern, "true")} UNION ALL {spans(2, "[0-9a-f]{16,}", "true")})),
tk AS (SELECT *, a + length(s) AS z FROM ({spans(3, TOKEN.pattern, "NOT regexp_full_match(m[k], '[0-9]+')")})),
ch AS (SELECT rid, a, z, s, unnest(range(1, length(s) + 1)) AS i FROM tk),
sc AS (SELECT rid, a, z, sum(r) / max(length(s)) AS score FROM ch JOIN ratio ON ratio.y = s[i] AND ratio.x = CASE WHEN i > 1 THEN s[i - 1] ELSE '' END GROUP BY 1, 2, 3),
al AS (SELECT rid, kind, a, z FROM fx UNION ALL SELECT rid, 3, a, z FROM sc WHERE score >= {threshold} AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.rid = sc.rid AND fx.a <= sc.a AND fx.z >= sc.z)),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed(" FILTER (kind < 3)")} AS base, {listed("")} AS spans FROM al GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)
"""
