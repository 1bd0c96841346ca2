"""Text to tokens: a Column pipeline, and the full analyzer as an Arrow-batched function."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import CODE_STOP_WORDS, PARTS, STOP_WORDS, WHOLE
from .porter import stem

SPLIT = r"[^\p{L}\p{N}]+"
_RUNS, _NEGATED = re.compile(r"[^\W_]+"), re.compile(r"(?:^|\s)-(\w+)")
_EDGES = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def words(text: Column) -> Column:
    """All words in order, lower case, repeats included; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def terms(text: Column) -> Column:
    """The distinct words in order of their first occurrence."""
    return F.array_distinct(words(text))


def count_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))


def _whole(word: str) -> str:
    # the word comes first, so that places without its first letter fail at once
    return rf"{re.escape(word)}(?<![\p{{L}}\p{{N}}]{re.escape(word)})(?![\p{{L}}\p{{N}}])"


def has_word(text: Column, word: str) -> Column:
    """Whether a text has a word, whatever the case; no array of words is made."""
    low = F.lower(text)
    return F.coalesce(low.contains(word) & low.rlike(_whole(word)), F.lit(False))


def count_word(text: Column, word: str) -> Column:
    """How often a text has a word."""
    low = F.lower(text)
    return F.when(low.contains(word), F.regexp_count(low, F.lit(_whole(word)))).otherwise(0)


def _compound(word: str, parts=PARTS) -> list[str]:
    """The fewest known parts that make up the word, else the word."""
    best: list = [[]] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 12), end):
            if best[start] is not None and word[start:end] in parts and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = [*best[start], word[start:end]]
    return best[-1] if best[-1] and len(best[-1]) > 1 else [word]


@functools.lru_cache(maxsize=400_000)
def _tokens(raw: str) -> tuple[str, ...]:
    """What one run of letters and digits becomes, wherever it stands."""
    return tuple(t for _, tokens in _parts(raw) for t in tokens)


def _parts(raw: str, divide=None) -> list[tuple[str, list[str]]]:
    """The parts of a run that count, in lower case, with the tokens of each. divide: how a compound is divided, else by PARTS."""
    out: list[tuple[str, list[str]]] = []
    low = raw.lower()
    for piece in [low] if low in WHOLE else [p.lower() for p in _EDGES.split(raw) if p]:
        if piece in STOP_WORDS or piece in CODE_STOP_WORDS or (piece.isdecimal() and len(piece) < 3 and int(piece) <= 10):
            continue
        for part in [piece] if piece in WHOLE else (divide or _compound)(piece):
            if part in STOP_WORDS:
                continue
            out.append((part, [part, stem(part)] if part in WHOLE else [stem(part)]))
    return out


def forms(text: str, lattice=None) -> dict[str, set[str]]:
    """For each token of a text the words, in lower case, that it comes from."""
    out: dict[str, set[str]] = {}
    for raw in _RUNS.findall(text):
        for part, tokens in _parts(raw, lattice and lattice.split):
            for t in tokens:
                out.setdefault(t, set()).add(part)
    return out


def tokenize(text: str | None, distinct: bool = True, lattice=None) -> list[str]:
    """Split, divide camel case and compounds, drop stop words and the integers to 10, stem; words that are never split also stay as they are.

    Null text has no tokens. A word's tokens don't depend on what stands around
    it, so that each distinct word is analysed once; words after a minus sign
    are taken out. lattice: the corpus's own words, by which compounds are
    divided (compounds.Lattice); without one, a few common parts are known.
    """
    text = text or ""
    tokens = lattice.tokens if lattice else _tokens
    out = [t for raw in _RUNS.findall(text) for t in tokens(raw)]
    if "-" in text and (negated := {stem(w.lower()) for w in _NEGATED.findall(text)}):
        out = [t for t in out if t not in negated]
    return list(dict.fromkeys(out)) if distinct else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def full_terms(text: pd.Series) -> pd.Series:
    return text.map(tokenize)


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_terms(text: pd.Series) -> pd.Series:
    """Tokens with repeats, of words after a minus sign too; null has none."""
    return text.map(lambda t: [x for raw in _RUNS.findall(t or "") for x in _tokens(raw)])
