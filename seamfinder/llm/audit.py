"""What each filter of a chain takes, alone and together, by inclusion and exclusion.

For every set of filters the rows that fail all of them are counted, as a sum of
products of flags; that is one pass over the rows. Everything else follows from
these counts. A Möbius inversion gives what survives any set of filters, so what
each order of the filters removes at each step, and what fails one filter alone.
The counts with alternating signs are the Harsanyi dividends of the game in which
a set of filters wins what it removes; shared out equally among a dividend's
filters they give the Shapley value.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Thresholds: words, distinct words and capitals of a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
NAMES = "ABCDE"
SIZE = 1 << len(NAMES)


def flags(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at it alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def subsets(mask: int) -> list[int]:
    return [m for m in range(SIZE) if m & ~mask == 0]


def bits(mask: int) -> int:
    return bin(mask).count("1")


def failures(docs: DataFrame, labels: DataFrame, s: Scratch) -> DataFrame:
    """(part, all, good, toxic): for each part and, in arrays by the set's number, how many rows fail all filters of a set."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *[c.alias(f"fails_{k}") for k, c in flags(text).items()])
    rows = s.keep(given, "rows")
    # of equal texts, what has the smallest id passes; a row for each text, joined by text and id, so that copies aren't a hot key
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    marked = rows.join(least, ["digest", "id"], "left").drop("digest")
    kinds = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    known = marked.join(kinds, "id", "left")
    fails = [F.col(f"fails_{k}").cast("long") for k in "ABCD"] + [(F.col("id").isNotNull() & F.col("is_first").isNull()).cast("long")]
    flagged = known.select("part", *[f.alias(f"f{i}") for i, f in enumerate(fails)], *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("quality", "toxic")])
    product = lambda m: reduce(lambda a, b: a * b, [F.col(f"f{i}") for i in range(len(NAMES)) if m >> i & 1], F.lit(1).cast("long"))
    sums = [F.sum(product(m) * w).alias(f"{name}_{m}") for name, w in (("all", F.lit(1)), ("good", F.col("quality")), ("toxic", F.col("toxic"))) for m in range(SIZE)]
    counted = flagged.groupBy("part").agg(*sums)
    return counted.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(SIZE)]).alias(name) for name in ("all", "good", "toxic")])


def survivors(joint: str) -> Column:
    """For each set of filters the rows that fail none of it: the Möbius inversion of the joint failures."""
    term = lambda t: F.get(joint, F.lit(t)) * (-1 if bits(t) % 2 else 1)
    return F.array(*[reduce(lambda a, b: a + b, map(term, subsets(m))) for m in range(SIZE)])


def alone(joint: str) -> Column:
    """For each filter the rows that fail it and no other."""
    out = []
    for i in range(len(NAMES)):
        rest = SIZE - 1 - (1 << i)
        out.append(reduce(lambda a, b: a + b, [F.get(joint, F.lit(t | 1 << i)) * (-1 if bits(t) % 2 else 1) for t in subsets(rest)]))
    return F.array(*out)


def shapley(joint: str) -> Column:
    """For each filter its Shapley value times the number of orders: a dividend is shared out equally among its filters."""
    orders = factorial(len(NAMES))
    out = []
    for i in range(len(NAMES)):
        out.append(reduce(lambda a, b: a + b, [F.get(joint, F.lit(t)) * (orders // bits(t) * (1 if bits(t) % 2 else -1)) for t in range(SIZE) if t >> i & 1]))
    return F.array(*out)


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows for each part.

    A part is a value of lang, null counting as the empty string. Filters: A
    under 200 words; B under 50 distinct words of a hundred; C more than 3
    capitals A-Z of a hundred code points; D any of ``#$%&*|``; E the text of a
    row with a smaller doc_id, in any part. Null texts are empty ones. A row
    without an id neither fails E nor makes others fail, and has no label;
    rows that repeat the smallest id of a text don't fail E. A row is good or
    toxic if any of its labels says so (null labels don't). An empty table gives
    an empty result; other columns aren't read.
    """
    joint = failures(docs, labels, scratch or Scratch(docs.sparkSession, "audit"))
    known = joint.select("part", F.col("all"), *[survivors(c).alias(f"left_{c}") for c in ("all", "good", "toxic")], alone("all").alias("alone"), shapley("all").alias("shapley"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(NAMES)]))
    steps = known.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))).alias("step"))
    names = F.array(*map(F.lit, NAMES))
    at = F.array_position(names, F.substr("filter_order", F.col("step"), F.lit(1))).cast("int") - 1
    own_bit = F.get(F.array(*[F.lit(1 << i) for i in range(len(NAMES))]), F.col("at"))
    before = reduce(lambda a, b: a + b, [F.when(F.instr("filter_order", k) < F.col("step"), 1 << i).otherwise(0) for i, k in enumerate(NAMES)])
    steps = steps.withColumns({"at": at, "before": before}).withColumn("own", own_bit).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("after"))
    own = F.get("all", F.col("own"))
    return steps.select("part", "filter_order", F.col("step").cast("int").alias("step"), F.get("left_all", F.col("after")).alias("kept"), lost("all").alias("removed"), (own - lost("all")).alias("redundant"), F.get("alone", F.col("at")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("at")).alias("shapley"))
