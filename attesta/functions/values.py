"""Scalar values: lists, fixed formats, costs, delays, JSON text, ids of sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import constants as K


def clean_list(items: Column) -> Column:
    """Trimmed, distinct, sorted texts without empty ones; an empty list for null."""
    tidy = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(tidy, lambda x: x != ""))), F.array().cast("array<string>"))


def fixed(digits: int):
    """Numbers as text with a fixed count of decimals, rounded from the exact binary value as C's printf does."""

    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}")

    return shown


def token_cost(tokens_in: Column, tokens_out: Column, price_in: str, price_out: str) -> Column:
    """Cost of a request from prices for a million tokens, in exact decimals."""
    price = lambda x: F.lit(x).cast("decimal(12,6)")
    whole = tokens_in.cast("decimal(18,0)") * price(price_in) + tokens_out.cast("decimal(18,0)") * price(price_out)
    return (whole / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(24,12)")


def retry_delay(backoff: Column, retry_after: Column, now: Column) -> Column:
    """Seconds to wait: the backoff, or more where ``retry_after`` (seconds or an HTTP date) asks for it; one at least."""
    seconds = F.expr("try_cast(null as double)") if retry_after is None else retry_after.try_cast("double")
    date = F.regexp_extract(retry_after, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    until = F.unix_timestamp(F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    return F.greatest(F.lit(1.0), backoff.cast("double"), F.coalesce(seconds, until.cast("double")))


def retry_reason(status: Column, text: Column, error_type: Column, transport_error: Column | None = None) -> Column:
    """Why a failed request may be sent again, or null: words that rule it out, then HTTP statuses, then connection words, then error types.

    A status that isn't given is read from the text.
    """
    words = F.lower(F.coalesce(text, F.lit("")))
    if transport_error is not None:
        words = F.concat(words, F.when(transport_error, F.lit(" upstream connection failed")).otherwise(""))
    said = F.regexp_extract(words, r"(?:api error:|http(?: status)?:?|status(?:_code)?[=:]?)\s*(\d{3})\b", 1)
    code = F.coalesce(status.cast("int"), F.when(said != "", said).cast("int"))
    holds = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(words, t))
    return (
        F.when(holds(K.FINAL_WORDS) | F.coalesce(code.isin(*K.FINAL_STATUSES), F.lit(False)), F.lit(None).cast("string"))
        .when(code.isin(*K.RETRY_STATUSES), F.concat(F.lit("temporary_http_"), code.cast("string")))
        .when(holds(K.CONNECTION_WORDS), "temporary_connection_error")
        .when(error_type.isin(*K.TRANSPORT_ERRORS), F.concat(F.lit("transport_"), error_type))
    )


def json_body(response: Column) -> Column:
    """The JSON text of a response, out of a fenced block if it is in one; null unless it parses."""
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    trimmed = stripped(response)
    inner = stripped(F.regexp_extract(trimmed, r"(?s)^```(?:json)?\n(.*)```$", 1))
    body = F.when(inner != "", inner).otherwise(trimmed)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def canonical_json(**cells: Column) -> Column:
    """One spelling of a row: JSON with sorted keys, no spaces, nulls and non-ASCII characters kept."""
    return F.to_json(F.struct(*[cells[name].alias(name) for name in sorted(cells)]), {"ignoreNullFields": "false"})


def forbidden_keys(document: Column, keys: list[str]) -> Column:
    """The keys at any depth of a JSON text that are in ``keys``, in lower case, sorted. Quotes inside strings are escaped, so they make no key."""
    found = F.regexp_extract_all(F.lower(document), F.lit(r'(?<!\\)"(' + "|".join(keys) + r')"\s*:'), 1)
    return F.array_sort(F.array_distinct(found))


def set_id(prefix: str, values: Column) -> Column:
    """prefix-, then 20 hex digits of SHA-256 over the sorted values joined by ||: whatever their order."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.array_join(F.array_sort(values), "||"), 256), 1, 20))


def in_page_json(document: Column) -> Column:
    """JSON text that can stand in a page's script: no tag can end or begin in it."""
    return F.replace(document, F.lit("<"), F.lit("\\u003c"))


def redacted(text: Column, secrets: list[str]) -> Column:
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text
