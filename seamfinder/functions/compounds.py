"""Compounds divided by the words of a corpus.

A word is divided where its parts are, on the geometric mean, counted more often
than itself (P. Koehn, K. Knight: Empirical Methods for Compound Splitting, 2003).
The best division into each number of parts is a path through a lattice of the
word's places, found by dynamic programming. The counts are a distributed
aggregate; what is broadcast is its top, of a stated size.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analyzer
from .lexicon import CODE_STOP_WORDS, STOP_WORDS

#: Letters of a part, and of a word that is looked at; the number of words that are kept at most, and how often they are there at least.
LEAST_PART, MOST_PART, MOST_WORD = 3, 24, 64
MOST_WORDS, LEAST_COUNT = 200_000, 2
#: Distinct words whose tokens a worker keeps at most.
KEPT = 400_000
_EDGES = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def pieces(text: Column) -> Column:
    """The words of a text after camel case and digits are divided, in lower case, repeats included; null has none."""
    return analyzer.words(F.regexp_replace(F.coalesce(text, F.lit("")), _EDGES, " "))


def counted(files: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, column: str = "content") -> DataFrame:
    """(word, n): the ``most`` most frequent words a to z of LEAST_PART to MOST_PART letters that aren't stop words, equal counts in the order of words."""
    return top(word_counts(files, column), most, least)


def word_counts(files: DataFrame, column: str = "content") -> DataFrame:
    """(word, n): how often each word is there."""
    return files.select(F.explode(pieces(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(counts: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """The words that compounds are divided by, of all counts (word, n)."""
    words = counts.where((F.col("n") >= least) & F.col("word").rlike(f"^[a-z]{{{LEAST_PART},{MOST_PART}}}$") & ~F.col("word").isin(*sorted(STOP_WORDS | CODE_STOP_WORDS)))
    return words.orderBy(F.desc("n"), "word").limit(most)


class Lattice:
    """Counts of words, at most MOST_WORDS, and the divisions that follow from them."""

    def __init__(self, counts: dict[str, int]):
        if len(counts) > MOST_WORDS:
            raise ValueError(f"a lattice has {MOST_WORDS} words at most, as it goes to every task")
        self.logs = {w: math.log(n) for w, n in counts.items()}
        self._kept: dict[str, tuple[str, ...]] = {}
        self._found = None

    def _matches(self, word: str):
        """(end, start, logarithm) of the known words in a word, by rising ends, by one automaton that each process builds."""
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for w, x in self.logs.items():
                if len(w) >= LEAST_PART:
                    self._found.add_word(w, (len(w), x))
            if len(self._found):
                self._found.make_automaton()
        if not len(self._found):
            return
        for at, (size, x) in self._found.iter(word):
            yield at + 1, at + 1 - size, x

    @classmethod
    def of(cls, files: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, column: str = "content") -> Lattice:
        return cls.by(word_counts(files, column), most, least)

    @classmethod
    def by(cls, counts: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> Lattice:
        return cls({r.word: r.n for r in top(counts, min(most, MOST_WORDS), least).collect()})  # ``most`` words at most

    def split(self, word: str) -> list[str]:
        """The parts of a word in lower case, or the word itself. Of equal means the division with fewer parts is taken, then the one whose last parts are longer."""
        size = len(word)
        if not 2 * LEAST_PART <= size <= MOST_WORD:
            return [word]
        most = size // LEAST_PART
        # best[end][n]: the greatest sum of logarithms of n parts that make up word[:end], and where the last begins
        best: list[dict[int, tuple[float, int]]] = [{} for _ in range(size + 1)]
        best[0][0] = (0.0, 0)
        for end, start, own in self._matches(word):
            if not best[start] or end - start == size:
                continue
            here = best[end]
            for n, (total, _) in best[start].items():
                if n < most and (n + 1 not in here or total + own > here[n + 1][0] + 1e-12):
                    here[n + 1] = (total + own, start)
        means = {n: total / n for n, (total, _) in best[size].items()}
        if not means:
            return [word]
        n = min(means, key=lambda k: (-round(means[k], 12), k))
        if means[n] <= self.logs.get(word, -1.0):
            return [word]
        out, end = [], size
        for k in range(n, 0, -1):
            start = best[end][k][1]
            out.append(word[start:end])
            end = start
        return out[::-1]

    def tokens(self, raw: str) -> tuple[str, ...]:
        """What one run of letters and digits becomes (analyzer), with these divisions."""
        found = self._kept.get(raw)
        if found is None:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            found = self._kept[raw] = tuple(t for _, ts in analyzer._parts(raw, self.split) for t in ts)
        return found

    def __getstate__(self):
        return {**self.__dict__, "_kept": {}, "_found": None}


def divided(words: DataFrame, lattice: Lattice, column: str = "word") -> DataFrame:
    """words with ``parts``. Null words have none; other columns stay, but for one of that name."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)  # MOST_WORDS words at most

    @F.pandas_udf("array<string>")
    def parts(word: pd.Series) -> pd.Series:
        return word.map(lambda w: None if w is None else shared.value.split(w))

    return words.withColumn("parts", parts(column))
