"""Line-first cleaning: judge each line, remove the failures, then judge the document.

Each line with a word is tested for punctuation, navigation and boilerplate; failing lines
go. A document is rejected if too much of its text went, or by the base measures on its whole text.
A row is judged by itself, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import shield, small_batches, unshield

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
# Menu labels and legal phrases of English pages, beside the rules on structure, which hold for any language.
_NAVIGATION = re.compile(rb"(?i)^\W*(?:home|menu|search|login|log in|sign in|sign up|register|contact(?: us)?|about(?: us)?|next|previous|back to top|skip to (?:main )?content|sitemap|share|tweet|print|read more|click here)\W*$")
_SEPARATORS = re.compile(rb"(?:^|\s)(?:\||>|\xc2\xbb|\xe2\x80\xba|\xe2\x80\xa2)(?:\s|$)")
_BOILERPLATE = re.compile(rb"(?i)all rights reserved|copyright (?:\(c\)|\xc2\xa9)|\xc2\xa9 ?\d{4}|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|subscribe to our newsletter")
_LINK = re.compile(rb"(?i)^[(<\"']?(?:https?://|www\.)")
#: A line of at most this many words without a mark at its end may be a menu entry; this many of them in a row are a menu.
_ENTRY_WORDS, _ENTRIES = 3, 4
_ENDS = (b".", b"!", b"?", b":", b";", b",", b"\"", b"'", b")", "…".encode(), "。".encode(), "！".encode(), "？".encode(), "»".encode(), "”".encode(), "’".encode())
#: A word sequence this long counts for the repeat measure.
_WINDOW = 5
#: From this many words the windows are ranked with arrays, which take less memory than tuples.
_ARRAYS_FROM = 200_000


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more, the first one included."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    if len(words) < _ARRAYS_FROM:
        windows = list(zip(*(words[k:] for k in range(_WINDOW)), strict=False))
        seen: dict = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, n)
        if len(seen) == n:
            return 0
        repeated = np.bincount(ids)[ids] > 1
    else:
        table: dict = {}
        ranks = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
        ids = ranks[:n]
        for k in range(1, _WINDOW):
            ids = np.unique(ids * len(words) + ranks[k : n + k], return_inverse=True)[1]
        repeated = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + _WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words is not running text.

    Punctuation: half of its words or more end in a run of marks. Navigation: it's a menu label alone, a list
    with a separator for every four words or fewer (three separators or more), or links for half of its words. Boilerplate: a legal or site phrase, or
    a line of eight words or more half of which repeat the word before.
    """
    n = len(words)
    if b"://" in line or b"www." in line:
        if 2 * sum(bool(_LINK.match(w)) for w in words) >= n:
            return True
    if line.translate(None, _SYMBOLS + b"!?~^=_+") != line:
        if 2 * sum(len(w) > 2 and w[-1] in b"!?#*$%&|<>~^=_+" and w[-2] in b"!?#*$%&|<>~^=_+" for w in words) >= n:
            return True
    if n >= 8 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= n - 1:
        return True
    separators = len(_SEPARATORS.findall(line))
    if separators >= 3 and separators * 5 >= n:
        return True
    return bool(_NAVIGATION.match(line)) or bool(_BOILERPLATE.search(line))


def menu_lines(held: list[tuple[bytes, list[bytes]]]) -> set[int]:
    """Places among the lines with words that make a menu: runs of short lines without a mark at their end."""
    out: set[int] = set()
    run: list[int] = []
    for at, (line, words) in enumerate([*held, (b".", [b"."])]):
        if len(words) <= _ENTRY_WORDS and not line.rstrip().endswith(_ENDS):
            run.append(at)
            continue
        if len(run) >= _ENTRIES:
            out.update(run)
        run = []
    return out


def measure(text: bytes, lost_percent: int) -> tuple:
    words = text.split()
    lines = text.split(b"\n")
    held = [(line, own) for line in lines if (own := line.split())]
    space = len(text) - len(text.translate(None, _SPACE))
    chars = len(text.translate(None, _CONTINUATION))
    n_repeat = repeat_words(words)
    kept_lines, gone, lost, seen = [], 0, 0, set()
    menu, at = menu_lines(held), -1
    for line in lines:
        own = line.split()
        at += bool(own)
        if own and (at in menu or line_fails(line, own) or len(own) > 3 and line in seen):
            gone += 1
            lost += len(line.translate(None, _SPACE + _CONTINUATION))
        else:
            kept_lines.append(line)
        if own:
            seen.add(line)
    base = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    kept = not base and 100 * lost <= lost_percent * (chars - space)
    clean = text if not gone else b"\n".join(kept_lines)
    return len(words), chars - space, len(text) - len(text.translate(None, _SYMBOLS)), len(held) - len({line for line, _ in held}), n_repeat, base, kept, len(held), gone, lost, clean.decode()


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "n_chars_removed", "clean_text"]
_KINDS = ["long"] * 5 + ["boolean"] * 2 + ["long"] * 3 + ["string"]


def _judged(docs: DataFrame, text_col: str, lost_percent: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under working names with ``__judged``, and the names."""
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(_OUT, _KINDS, strict=True))

    @F.pandas_udf(schema)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(bytes(x), lost_percent) for x in batch], columns=_OUT)

    own, columns = shield(small_batches(docs))
    # Marked so that a filter on the verdict stays above it: pushed below, it would judge every text a second time.
    judged = judge.asNondeterministic()(F.coalesce(F.col(columns[text_col]), F.lit("")).cast("binary"))
    return own.withColumn("__judged", judged), columns


def quality_rules(docs: DataFrame, text_col: str = "text", lost_percent: int = 30) -> DataFrame:
    """All rows and columns of ``docs`` with the measures, the verdict and the cleaned text.

    Words are runs outside space, tab, newline, vertical tab, form feed and return. ``kept`` is false if the base measures fail
    (fewer than 10 words, or over a fifth of them in repeated 5-word windows) or if the removed lines hold over
    ``lost_percent`` of the characters in words; at the limit itself a text is kept. Removed lines fail a line rule, stand in a menu (four lines or more of up to three words without a mark at their end) or repeat an earlier line of over three words.
    A null or empty text has no word and fails; its clean text is empty. Texts of any length are judged whole. Every row is judged by itself, so repeated rows
    and rows that share an id agree. Input columns named as the output ones may hold the text and are replaced; an empty table gives an empty result.
    """
    found, columns = _judged(docs, text_col, lost_percent)
    for name in _OUT:
        found = found.withColumn(name, F.col(f"__judged.{name}"))
    return unshield(found, columns, _OUT)


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", lost_percent: int = 30) -> DataFrame:
    """The kept rows with the cleaned text in place of the text, and its length in ``chars_col`` if there is one.

    All other columns stay as they are, also those named as the measures.
    """
    found, columns = _judged(docs, text_col, lost_percent)
    cells = {c: F.col(n) for c, n in columns.items()}
    cells[text_col] = F.col("__judged.clean_text")
    if chars_col in cells:
        cells[chars_col] = F.char_length("__judged.clean_text").cast(dict(docs.dtypes)[chars_col])
    return found.filter("__judged.kept").select(*[cell.alias(c) for c, cell in cells.items()])
