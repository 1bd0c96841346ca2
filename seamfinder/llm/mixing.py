"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets the rate ``min(limit, exp(lambda_s * size / mean size of s))``
that tilts its source s as little as possible (in relative entropy) under the
constraint that rate times size sums to the source's target. lambda_s is the
optimum of a convex dual in one variable per source. Newton steps on the
logarithm of the constraint, kept inside a bracket, find all of them at once:
each step is one aggregate over the table of (source, size, number of
documents), which is as long as there are distinct sizes.

Rates become copies by sequential Poisson sampling: the whole part of the rate
is taken, then documents are taken once more in the order of u / fraction (u:
hash of the id, uniform), until the source's words are all there. The order is
found through a histogram of that key, so that no task sees a whole source. The
last copy of a source is cut to the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Relative distance to the target at which a source's Newton steps end; and their number at most.
TOLERANCE, STEPS = 1e-7, 60
#: Documents of a source in a bin of the rounding's histogram, about.
PER_BIN = 1000


def size_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, n, s, least, target): by code point, null last, the weights repeat; what exceeds ``limit`` times a source goes to the others by weight.

    With the sources in the order of limit * s / weight, those before the first
    whose share of the rest stays below its limit are full.
    """
    per = sized.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.sum("size").alias("s"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int")))
    order = Window.orderBy(F.col("s") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("s").over(all_of) - F.coalesce(F.sum(limit * F.col("s")).over(before), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= limit * F.col("s"))
    water = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(all_of)
    return w.withColumn("target", F.least(water * F.col("w"), limit * F.col("s").cast("double"))).select("source", "n", "s", "least", F.coalesce("target", F.lit(0.0)).alias("target"))


def _tilts(hist: DataFrame, wanted: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """wanted with lam, mean and full (every document at the limit)."""
    t, s, lam = F.col("target"), F.col("s"), F.col("lam")
    start = wanted.withColumn("mean", s / F.nullif(F.col("n"), F.lit(0))).withColumn("full", t >= limit * s).withColumn("unit", F.col("least") / F.col("mean")) \
        .withColumn("hi", F.log(F.lit(limit * 1.0)) / F.col("unit")).withColumn("lo", F.least(F.lit(0.0), F.log(t / F.nullif(s, F.lit(0))) / F.col("unit"))) \
        .withColumn("lam", F.lit(0.0)).withColumn("done", (s == 0) | (t <= 0) | F.col("full") | (F.abs(t - s) <= TOLERANCE * t)).drop("unit")
    state, names = scratch.keep(start, "tilt-0"), start.columns
    for step in range(1, STEPS + 1):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate, inner = F.least(F.lit(limit * 1.0), F.exp(lam * x)), lam * x < F.log(F.lit(limit * 1.0))
        mass = F.col("docs") * F.col("size")
        sums = hist.join(state.where("not done"), F.col("key").eqNullSafe(F.col("source"))) \
            .groupBy("source").agg(F.sum(mass * rate).alias("g"), F.sum(F.when(inner, mass * x * rate).otherwise(0.0)).alias("h")) \
            .select(F.col("source").alias("of"), "g", "h")
        lo, hi = F.when(F.col("g") < t, lam).otherwise(F.col("lo")), F.when(F.col("g") > t, lam).otherwise(F.col("hi"))
        newton = F.when(F.col("h") > 0, lam - F.log(F.col("g") / t) * F.col("g") / F.col("h"))
        inside = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        near = F.abs(F.col("g") - t) <= TOLERANCE * t
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumns({
            "lam": F.when(F.col("g").isNull() | near, lam).otherwise(inside),
            "lo": F.when(F.col("g").isNull(), F.col("lo")).otherwise(lo),
            "hi": F.when(F.col("g").isNull(), F.col("hi")).otherwise(hi),
            "done": F.col("done") | F.coalesce(near, F.lit(False)),
        }).select(*names)
        state = scratch.keep(moved, f"tilt-{step}")
        scratch.drop(f"tilt-{step - 1}")
    return state


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """The mixed documents: docs' columns, a row for each copy; a cut copy has the first words only, joined by a space.

    Null and empty texts have no words and aren't in the mix. Otherwise as
    ``mix``: repeated rows are decided one by one, null ids and null sources
    are kept, an empty table gives an empty result, and columns of any names
    pass through. Whole rows are scanned and given copies where they lie; only
    the few that tie with a source's last document are moved.
    """
    sc = scratch or Scratch(docs.sparkSession, "mixing")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    narrow = row.select("id", "source", size_of("text").alias("size"))
    plan = _plan(narrow, sc, weights, limit, seed)
    mixed = _decided(row.withColumn("size", size_of("text")), plan, "row").where("copies > 0 or cut > 0")
    copies = mixed.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") + F.when(F.col("cut") > 0, 1).otherwise(0))))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(f"({WORD})"), F.lit(1)), 1, F.col("cut").cast("int")), " ")
    text = F.when(F.col("k") > F.col("copies"), first).otherwise(F.col("row")[text_col])
    return copies.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _plan(narrow: DataFrame, sc: Scratch, weights, limit: int, seed: int) -> tuple:
    """What decides a row of (id, source, size): the tilts and the last document of each source, and the columns made of them."""
    sized = sc.keep(narrow, "sized")
    wanted = sc.keep(targets(sized, weights, limit), "wanted")
    hist = sc.keep(sized.where("size > 0").groupBy(F.col("source").alias("key"), "size").agg(F.count("*").alias("docs")), "hist")
    tilt = sc.keep(_tilts(hist, wanted, sc, limit).select(F.col("source").alias("of"), "s", "n", "target", "lam", "mean", "full"), "tilt")

    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("full"), float(limit)).otherwise(F.least(F.lit(float(limit)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) + 1) / F.lit(float(1 << 53))
    bins = F.greatest(F.lit(1.0), F.col("n") / PER_BIN)

    def rated(df: DataFrame) -> DataFrame:
        return df.join(tilt, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("base", F.floor("rate")) \
            .withColumn("turn", F.when(F.col("rate") > F.col("base"), u / (F.col("rate") - F.col("base")))) \
            .withColumn("bin", F.floor(F.least(F.col("turn"), F.lit(8.0)) * bins)).drop("of")

    # one row per source and bin; base rows (bin null) come first
    own = rated(sized)
    per = own.groupBy("source", "bin").agg(F.sum(F.col("base") * F.col("size")).alias("given"), F.sum("size").alias("more"), F.first("target").alias("target"))
    whole = Window.partitionBy("source")
    ordered = whole.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    due = per.withColumn("due", F.col("target") - F.sum("given").over(whole)).withColumn("more", F.when(F.col("bin").isNull(), 0).otherwise(F.col("more"))) \
        .withColumn("before", F.coalesce(F.sum("more").over(ordered), F.lit(0)))
    # without such a bin, all documents of the source with a fraction are taken once more
    cut_bin = sc.keep(due.where((F.col("before") <= F.col("due")) & (F.col("before") + F.col("more") > F.col("due")) & F.col("bin").isNotNull())
                      .select(F.col("source").alias("of"), F.col("bin").alias("at"), (F.col("due") - F.col("before")).alias("rest")), "bins")
    # the bin's documents, equal ones together: the first lot with which the source has enough
    lots = own.join(cut_bin, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at"))).groupBy("source", "turn", "id", "size").agg(F.count("*").alias("equal"), F.first("rest").alias("rest"))
    turn = Window.partitionBy("source").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = lots.withColumn("rest", F.col("rest") - F.coalesce(F.sum(F.col("equal") * F.col("size")).over(turn), F.lit(0)))
    edge = left.where((F.col("rest") >= 0) & (F.col("rest") < F.col("equal") * F.col("size"))) \
        .select(F.col("source").alias("of"), F.struct("turn", "id", "size").alias("last"), F.floor(F.col("rest") / F.col("size")).alias("whole"), F.round(F.pmod("rest", F.col("size"))).cast("long").alias("part"))
    return rated, sc.keep(edge, "edge")


def _decided(rows: DataFrame, plan: tuple, *more: str) -> DataFrame:
    """rows (id, source, size, more) with source_size, target, copies and cut."""
    rated, edge = plan
    joined = rated(rows).join(edge, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("own", F.struct("turn", "id", "size"))
    none = F.lit(0).cast("long")
    extra = F.when(F.col("turn").isNull() | (F.col("own") > F.col("last")), 0).otherwise(1)
    tied = F.col("turn").isNotNull() & F.col("own").eqNullSafe(F.col("last"))
    plain = joined.where(~tied).withColumn("extra", extra).withColumn("cut", none)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.lit(0)))
    last = joined.where(tied).withColumn("place", place) \
        .withColumn("extra", F.when(F.col("place") <= F.col("whole"), 1).otherwise(0)).withColumn("cut", F.when(F.col("place") == F.col("whole") + 1, F.col("part")).otherwise(none))
    cols = ["id", "source", "size", F.col("s").alias("source_size"), "target", (F.col("base") + F.col("extra")).cast("long").alias("copies"), "cut", *more]
    return plain.select(*cols).unionByName(last.select(*cols))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, cut, taken) for every row of docs.

    copies: whole copies that the mix takes; cut: words of one more, cut, copy
    (at most one row of a source has one); taken = copies * size + cut.

    Null texts have size 0, a null source is a source of its own, after the
    others. Repeated rows count as often as they are there, and rows with a
    null id are kept; rows that tie in everything are told apart by nothing
    else, so which of them is cut doesn't matter. An empty table gives an
    empty result. Other columns aren't read. Reruns agree.
    """
    sc = scratch or Scratch(docs.sparkSession, "mixing")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    plan = _plan(narrow, sc, weights, limit, seed)
    sized = docs.sparkSession.read.schema(narrow.schema).parquet(sc.path("sized"))
    return _decided(sized, plan).withColumn("taken", F.col("copies") * F.col("size") + F.col("cut"))
