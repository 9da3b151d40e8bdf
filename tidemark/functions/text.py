"""Text, URL and hash functions as columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track.
TRACKING = r"^(utm_.*|fbclid|gclid)$"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form, for which Spark has no function."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def segments(text: Column) -> Column:
    """Runs of ASCII letters and digits, and runs of Hangul syllables."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9a-z]+|[가-힣]+)"), 1)


def tokenize(text: Column) -> Column:
    """ASCII runs whole, Hangul runs as pairs of syllables."""

    def split(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda k: F.substring(w, k, F.lit(2)))
        return F.when(w.rlike("^[0-9a-z]") | (F.length(w) < 2), F.array(w)).otherwise(pairs)

    runs = segments(text)
    return F.when(text.rlike("[가-힣]"), F.flatten(F.transform(runs, split))).otherwise(runs)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references of HTML as characters, for which Spark has no function."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


@F.pandas_udf(StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """A host name in its ASCII form; NULL where it has none."""

    def convert(h: str | None) -> str | None:
        if h is None or h.isascii():
            return h
        try:
            return h.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return hosts.map(convert)


def canonical_url(url: Column) -> Column:
    """Without fragment, default port and tracking parameters; NULL if invalid.

    Scheme and host in lower case, the host in ASCII; path and order of
    parameters stay.
    """
    fine = ~url.rlike(r"[\x00-\x20\x7f]")
    url = unescape(url)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)
    host = ascii_host(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")))
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING)), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(fine & scheme.isin("http", "https") & (host != "") & ~authority.contains("@"), whole)


def plain_text(page: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags gone, references
    turned into characters, white space collapsed.

    Tags vanish; only white space of the page itself separates words.
    """
    x = F.regexp_replace(page, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    x = unescape(F.regexp_replace(x, r"(?s)</?[A-Za-z!][^>]*>", ""))
    return F.trim(F.regexp_replace(x, r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def content_hash(*fields: str) -> Column:
    """First 16 hex digits of the hash of the fields, NULL unlike empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in fields)), 256), 1, 16)
