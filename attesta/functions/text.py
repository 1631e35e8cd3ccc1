"""Scalar text functions on columns."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company-form words dropped from names, in both variants.
SUFFIXES = ["incorporated", "inc", "corp", "corporation", "company", "co", "llc", "ltd", "limited"]
SUFFIXES_GROUP = [*SUFFIXES, "group"]
# Domains whose last two labels are a public suffix.
SECOND_LEVEL = ["co.uk", "com.au", "co.jp", "com.br", "com.cn", "co.in"]
# Query parameters that track a visit.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]


def normalize_name(name: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Words of letters and digits without company-form words: HTML unescaped, case folded, form words dropped before punctuation."""
    from attesta.functions.names import name_key

    return name_key(name, "group" if suffixes is SUFFIXES_GROUP else "plain")


def token_set(name: Column) -> Column:
    """Distinct words of over one character of the normalised name."""
    return F.array_distinct(F.filter(F.split(normalize_name(name, SUFFIXES_GROUP), " "), lambda w: F.length(w) > 1))


def acronym(name: Column) -> Column:
    """First letters of the words other than the, and, of, in the name with abbreviations spelled out."""
    from attesta.functions.names import name_key

    return F.array_join(F.transform(F.filter(F.split(name_key(name, "expanded"), " "), lambda w: ~w.isin("the", "and", "of")), lambda w: w.substr(1, 1)), "")


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty unless the scheme is http or https."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def registrable_domain(name: Column) -> Column:
    """Last two labels of a host without www., or three below a public second level."""
    labels = F.split(F.regexp_replace(name, r"^www\.", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*SECOND_LEVEL), three).otherwise(two)


def _form_encoded(part: Column) -> Column:
    """One spelling of a query's name or value: decoded, then percent-encoded with + for a space. What isn't valid encoding is taken literally."""
    plain = F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One spelling of an http(s) URL; empty for anything else.

    Stripped; scheme and host in lower case, no user, no port 80 or 443, no doubled or trailing slash, no tracking
    parameters (order and blank values of the others stay, a bare name gets a blank value, all are encoded anew), no fragment.
    """
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    port = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise("/")
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(_form_encoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _form_encoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))).otherwise("").alias("v")))
    kept = F.filter(split, lambda x: ~F.lower(x["k"]).isin(*TRACKING) & ~F.lower(x["k"]).startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    site = F.concat(host(url), F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(""))
    whole = F.concat(scheme, F.lit("://"), site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host(url) != "", whole).otherwise("")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-, then 20 hex digits of SHA-256 over the parts joined by |; null counts as empty."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20))


def parse_bool(value: Column) -> Column:
    """True or false from text; anything else raises."""
    word = F.lower(F.trim(value))
    return F.when(word == "true", True).when(word == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(value, F.lit("null")))).cast("boolean"))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether the lower-cased text holds any of the terms."""
    lowered = F.lower(text)
    found = F.lit(False)
    for term in terms:
        found = found | lowered.contains(term)
    return found


def token_jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


@F.pandas_udf(T.StringType())
def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded, NFKC, white space collapsed and stripped."""
    for batch in batches:
        yield batch.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", html.unescape(x)).split()))


@F.pandas_udf(T.StringType())
def quote_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A quote for literal comparison: NFKC, outer quote marks off, ellipsis and dashes plain, white space collapsed, casefolded."""
    for batch in batches:
        yield batch.map(lambda x: None if x is None else _quote_key(x))


def _quote_key(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).strip().strip("\"'“”‘’")
    for mark, plain in (("…", "..."), ("–", "-"), ("—", "-")):
        text = text.replace(mark, plain)
    return re.sub(r"\s+", " ", text).casefold().strip()


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters each of ``a`` has in common with its partner of ``b`` in the same order, for all pairs at once; of names over 63 characters a bound from above."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    found, few = np.minimum(la, lb), np.flatnonzero((la < 64) & (lb < 64))
    codes = lambda names, sizes, pad: np.where(np.arange(64) < sizes[few, None], np.array([names[i] for i in few], "U64").view(np.uint32).reshape(-1, 64), np.uint32(pad))
    if few.size:
        x, y = codes(a, la, 0xFFFFFFFE), codes(b, lb, 0xFFFFFFFF)
        free = np.full(few.size, 0xFFFFFFFFFFFFFFFF, np.uint64)  # a's characters without a partner
        for at in range(int(lb[few].max())):
            hit = free & np.packbits(x == y[:, at, None], axis=1, bitorder="little").view("<u8").ravel()
            free = (free + hit) | (free - hit)
        found[few] = 64 - np.bitwise_count(free)
    return found


def alias_udf(least_length: int, ratio: float, acronyms: bool):
    """Whether two normalised names name the same: equal, one inside the other, an acronym, or a close match by blocks in either order."""

    def initials(name: str) -> str:
        return "".join(w[0] for w in name.split() if w not in ("the", "and", "of"))

    def same(a: str, b: str, common: int, close: Callable[[str, str], bool]) -> bool:
        if not a or not b:
            return False
        if a == b or min(len(a), len(b)) >= least_length and (a in b or b in a):
            return True
        if acronyms and (a == initials(b) or b == initials(a)):
            return True
        return common >= ratio * (len(a) + len(b)) / 2 - 1e-9 and (close(a, b) or close(b, a))

    @F.pandas_udf("boolean")
    def alias(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = lru_cache(4096)(lambda name: SequenceMatcher(None, "", name))

        def close(a: str, b: str) -> bool:
            by_blocks = matcher(b)
            by_blocks.set_seq1(a)
            return by_blocks.ratio() >= ratio

        for a, b in pairs:
            a, b = a.fillna("").tolist(), b.fillna("").tolist()
            yield pd.Series([same(x, y, n, close) for x, y, n in zip(a, b, common_lengths(a, b), strict=True)], dtype=bool)

    return alias.asNondeterministic()  # else a filter on it goes below a distinct, and judges each pair as often as it was found
