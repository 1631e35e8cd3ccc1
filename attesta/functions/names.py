"""Keys of business names, in the variants that different steps compare, and names read from pages."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import constants as K
from attesta.functions.text import SUFFIXES, SUFFIXES_GROUP

#: Variants of ``name_key``: HTML unescaped or NFKC, company-form words, parentheses dropped, words expanded.
VARIANTS = {
    "plain": (True, "|".join(SUFFIXES), False, False),
    "group": (True, "|".join(SUFFIXES_GROUP), False, False),
    "forms": (False, K.FORM_WORDS, True, False),
    "expanded": (False, K.FORM_WORDS, True, True),
}


@F.pandas_udf(T.StringType())
def unescaped_folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded, then full case folding, which no built-in function has."""
    for batch in batches:
        yield batch.map(lambda x: None if x is None else html.unescape(x).casefold())


@F.pandas_udf(T.StringType())
def nfkc_folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, then full case folding."""
    for batch in batches:
        yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def name_key(name: Column, variant: str = "plain") -> Column:
    """Words of a-z and 0-9 without company-form words, in the ``variant`` named; null stays null.

    Form words go before punctuation does, so a form word is one only where letters, digits and underscores end on both sides.
    """
    unescape, forms, parentheses, expand = VARIANTS[variant]
    key = unescaped_folded(name) if unescape else nfkc_folded(name)
    if parentheses:
        key = F.regexp_replace(key, r"\([^)]*\)", " ")
    key = F.regexp_replace(key, rf"(?U)\b({forms})\b", " ")
    words = F.filter(F.split(F.regexp_replace(key, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    if expand:
        longer = F.create_map(*[F.lit(x) for pair in K.ABBREVIATIONS.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(longer, w), w))
    return F.array_join(words, " ")


@F.pandas_udf(T.StringType())
def size_quote_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A quote of size evidence: NFKC, straight quotation marks, white space collapsed, casefolded. Outer marks stay."""
    straight = str.maketrans("“”‘’", "\"\"''")
    for batch in batches:
        yield batch.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).translate(straight)).strip().casefold())


def candidate_name(site_name: Column, title: Column, domain: Column) -> Column:
    """The first of site name and title whose part before a spaced bar or dash has 2 to 119 characters and isn't a home page's; else the domain's first label."""
    head = lambda x: F.trim(F.element_at(F.split(F.coalesce(x, F.lit("")), r"\s+[|—–-]\s+"), 1))
    usable = lambda x: F.when(F.length(x).between(2, 119) & ~F.lower(x).isin("home", "homepage"), x)
    label = F.initcap(F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(" ")))
    return F.coalesce(usable(head(site_name)), usable(head(title)), label)
