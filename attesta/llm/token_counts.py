"""Token counts under a unigram vocabulary with dynamic programming shared over a trie.

A text is cut into pre-tokens. The distinct pre-tokens of a task form a trie; a depth-first walk
over it keeps the best unigram score of every prefix, so each shared prefix is scored once, and the number of
tokens on the best path is stored at the terminals. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import shield, small_batches, unshield

#: A word with the space before it, or a run of other white space.
_PRETOKEN = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+")
#: Longer pre-tokens, such as long runs without white space, are scored by themselves: in a trie they would share little.
_IN_TRIE = 1024


def read_ranks(path: str) -> dict[bytes, float]:
    """Piece -> log weight from a file of base64 pieces and ranks: weights fall as one over the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): -math.log(int(rank) + 1) for piece, rank in (line.split() for line in lines if line.strip())}


class TrieCounter:
    """Token counts of pre-tokens; ``most`` bounds the terminals kept between batches.

    Ties between paths of equal score go to the one with fewer tokens. A byte outside the vocabulary is one token at the
    score of the rarest piece.
    """

    def __init__(self, scores: dict[bytes, float], most: int = 200_000):
        # Every suffix of a piece is a key, without a score unless it is a piece: where none fits, no longer piece ends.
        self.ends: dict[bytes, float | None] = {piece[k:]: None for piece in scores for k in range(1, len(piece))} | scores
        self.floor = min(scores.values(), default=0.0)
        self.longest = max(map(len, scores), default=1)
        self.most = most
        self.terminals: dict[bytes, int] = {}

    def add(self, words: set[bytes]) -> None:
        """Insert ``words``: in sorted order, a depth-first walk of their trie.

        The stacks hold best scores and token counts for the prefixes of the current path; the next word keeps
        those of the prefix it shares with the one before.
        """
        ends, floor, terminals = self.ends, self.floor, self.terminals
        best, count = [0.0], [0]
        last = b""
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(last))
            while shared < limit and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = best[end - 1] + floor, count[end - 1] + 1
                for start in range(end - 1, -1, -1):
                    own = ends.get(word[start:end], False)
                    if own is False:
                        break
                    if own is not None:
                        own += best[start]
                        if own > top or own == top and count[start] + 1 < tokens:
                            top, tokens = own, count[start] + 1
                best.append(top)
                count.append(tokens)
            terminals[word] = count[-1]
            last = word

    def count_long(self, word: bytes) -> int:
        """Tokens of a pre-token of any length: the forward scores reach back one longest piece at most, so only these are kept."""
        ends, floor, keep = self.ends, self.floor, self.longest
        best, count, base = [0.0], [0], 0  # of the prefixes from `base` on
        for end in range(1, len(word) + 1):
            top, tokens = best[-1] + floor, count[-1] + 1
            for start in range(end - 1, -1, -1):
                own = ends.get(word[start:end], False)
                if own is False:
                    break
                if own is not None:
                    own += best[start - base]
                    if own > top or own == top and count[start - base] + 1 < tokens:
                        top, tokens = own, count[start - base] + 1
            best.append(top)
            count.append(tokens)
            if len(best) > 2 * keep + 4096:
                gone = len(best) - keep - 1
                del best[:gone], count[:gone]
                base += gone
        return count[-1]

    def pieces(self, text: bytes, most: int) -> list[tuple[int, int, int]]:
        """(first byte, end byte, tokens) of runs of whole pre-tokens of at most ``most`` tokens.

        A pre-token of more tokens is halved until the parts, each counted by itself, fit.
        """
        out: list[tuple[int, int, int]] = []
        first, at, sum_ = 0, 0, 0
        words = _PRETOKEN.findall(text)
        self.add({w for w in words if len(w) <= _IN_TRIE and w not in self.terminals})
        for word in words:
            n = self.terminals[word] if len(word) <= _IN_TRIE else self.count_long(word)
            if sum_ + n > most and sum_:
                out.append((first, at, sum_))
                first, sum_ = at, 0
            if n > most:
                parts = [(at, word)]
                while parts:
                    lo, part = parts.pop()
                    own = self.count_long(part)
                    if own > most:  # a byte is one token at most, so halving ends
                        half = len(part) // 2
                        parts += [(lo + half, part[half:]), (lo, part[:half])]
                    else:
                        out.append((lo, lo + len(part), own))
                first = at + len(word)
            else:
                sum_ += n
            at += len(word)
        if sum_:
            out.append((first, at, sum_))
        return out

    def count_texts(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(tokens, pre-tokens, bytes) of each text."""
        split = [_PRETOKEN.findall(text) for text in texts]
        every = {word for words in split for word in words}
        long = {word: self.count_long(word) for word in every if len(word) > _IN_TRIE}
        new = {word for word in every if word not in self.terminals and word not in long}
        if len(self.terminals) + len(new) > self.most:
            self.terminals = {}
            new = every - long.keys()
        self.add(new)
        get = (self.terminals | long).__getitem__ if long else self.terminals.__getitem__
        return [(sum(map(get, words)), len(words), len(text)) for words, text in zip(split, texts, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_tokens``, ``n_pretokens`` and ``n_bytes``.

    ``vocabulary`` is the path of a rank file; it is read on the driver and broadcast (its size bounds it). A null or empty text has
    no token. Rows are counted each by themselves, so repeated rows and rows that share an id agree. Paths of equal score tie as ``TrieCounter``
    says. Texts and pre-tokens of any length are counted whole, long pre-tokens with a bounded window of scores. Input columns
    named as the output ones may hold the text and are replaced; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    names = ["n_tokens", "n_pretokens", "n_bytes"]

    @F.pandas_udf("n_tokens long, n_pretokens long, n_bytes long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = TrieCounter(held.value)
        for batch in batches:
            rows, part, size = [], [], 0
            for text in batch:
                part.append(bytes(text))
                size += len(text)
                if size > chunk_bytes:
                    rows += trie.count_texts(part)
                    part, size = [], 0
            yield pd.DataFrame(rows + trie.count_texts(part), columns=names)

    own, columns = shield(small_batches(docs))
    found = own.withColumn("__counted", counted(F.coalesce(F.col(columns[text_col]), F.lit("")).cast("binary")))
    for name in names:
        found = found.withColumn(name, F.col(f"__counted.{name}"))
    return unshield(found, columns, names)


def token_pieces(docs: DataFrame, vocabulary: str, longest: int, text_col: str = "text") -> DataFrame:
    """One row per piece of each text, with the row's other columns, ``piece``, ``start`` (byte), ``n_tokens`` and the piece's own text.

    Pieces are runs of whole pre-tokens of at most ``longest`` tokens, in order, and joined they give the text; a pre-token of more tokens
    is halved, which may split a character: the text is binary. A null or empty text has no piece. Output columns replace input ones of
    their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    out = ["piece", "start", "n_tokens", text_col]

    @F.pandas_udf("array<struct<piece:bigint,start:bigint,n_tokens:bigint,text:binary>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = TrieCounter(held.value)
        for batch in batches:
            if len(trie.terminals) > trie.most:
                trie.terminals = {}
            yield pd.Series([[{"piece": k, "start": lo, "n_tokens": n, "text": bytes(text)[lo:hi]} for k, (lo, hi, n) in enumerate(trie.pieces(bytes(text), longest))] for text in batch])

    own, columns = shield(small_batches(docs))
    # Marked so that the filter that explode implies stays above it: pushed below, it would cut every text a second time.
    found = own.withColumn("__pieces", pieces.asNondeterministic()(F.coalesce(F.col(columns[text_col]), F.lit("")).cast("binary")))
    found = found.withColumn("__one", F.explode("__pieces"))
    return found.select(*[F.col(n).alias(c) for c, n in columns.items() if c not in out], *[F.col(f"__one.{x}").alias(x) for x in out[:3]], F.col("__one.text").alias(text_col))
