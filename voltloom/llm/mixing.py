"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document of a source gets the rate min(2, exp(tilt * size / mean size)): of all rates up to 2 whose expected words
meet the source's target, those nearest to one copy each in relative entropy. The tilt is the zero of a monotone
function, the derivative of the convex dual, and is found by Newton steps kept inside a bracket. All sums run over the counts of
(source, size), exact decimals of rounded terms, so reruns agree to the last copy. Rates become copies by systematic rounding in
the order of size, which keeps a source's words within about one document of its target.

Targets: weights 3, 1, 2 repeating over the sources by code point, null last; the excess of a source above twice its size goes
to the others by weight until none is above.

Defined results: null text has size 0; documents without words are never copied; a null source is a source of its own; rows with the
same doc_id, source and size have consecutive places of their own; ties of size are ordered by doc_id; an empty
table gives no rows; extra columns are ignored by ``mix`` and kept by ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pii import free_name
from .tables import BROADCAST_ROWS, few, ranked, stored

#: Fixed values of the mix.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MOST_COPIES = 1.5, 2
#: A source has converged when its expected words are this close to its target, relative to it.
TOLERANCE, STEPS = 1e-5, 60
_BLANK = " \t\n\x0b\f\r"
_EXACT = "decimal(38,9)"


def size_of(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_BLANK}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, size, n); few values per round reach the driver."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    by_name = ranked(sources, [F.col("source").asc_nulls_last()], "mix-sources", "place")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("place").cast("int") % len(WEIGHTS))
    t = stored(by_name.withColumn("weight", weight).drop("place"), "mix-weights")
    cap = (MOST_COPIES * F.col("source_size")).cast("double")
    whole = t.agg(F.sum("source_size")).first()[0] or 0
    level, aim = 0.0, TOTAL_SHARE * whole
    while aim > 0:  # the level rises only; at most one round per source, in practice a handful
        full = cap <= level * F.col("weight")
        taken, free = t.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        new = (aim - (taken or 0.0)) / free
        if new <= level * (1 + 1e-12):
            break
        level = new
    return t.withColumn("target", F.least(cap, F.col("weight") * level))


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    """The bounded exponential rate; sizes of 0 are not copied."""
    # exp is kept away from overflow; beyond the bound it is 2 anyway.
    grown = F.exp(F.least(F.lit(2.0), F.greatest(F.lit(-700.0), tilt * size / mean)))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(MOST_COPIES)), grown))


def tilts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tilt, mean): Newton steps of all sources at once, each a Spark job over the counts of sizes."""
    per = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))).alias("mean"))
    start = targets.join(per, targets["source"].eqNullSafe(per["source"])).select(
        targets["source"], "target", "source_size", F.greatest(F.lit(1.0), F.col("mean")).alias("mean"),
        F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    state = stored(start, "mix-tilt")
    side = F.broadcast if state.count() <= BROADCAST_ROWS else lambda t: t
    words = (F.col("size") * F.col("n")).cast("double")
    for _ in range(STEPS):
        joined = sizes.join(side(state).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where(~F.col("done"))
        r = rate(F.col("tilt"), F.col("size"), F.col("mean"))
        slope = F.when(r < MOST_COPIES, words * r * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy(F.col("source").alias("_s")).agg(F.sum((words * r).cast(_EXACT)).cast("double").alias("got"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        both = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        # Newton's step for the logarithm of the expected words, which is closer to a line.
        newton = F.when((F.col("slope") > 0) & (F.col("target") > 0), F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope"))
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("tilt")) < 10)
        # Outside the bracket: halve it, or step out further where it is still open.
        other = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(low.isNotNull(), low.cast("double") * 2 + 1).otherwise(high * 2 - 1)
        done = F.col("done") | F.coalesce(F.abs(miss) <= TOLERANCE * F.col("target"), F.lit(True))
        state = stored(both.select(
            "source", "target", "source_size", "mean", F.when(done, F.col("tilt")).when(inside, newton).otherwise(other).alias("tilt"),
            low.alias("low"), high.alias("high"), done.alias("done"),
        ), "mix-tilt")
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "mean", "tilt")


def decisions(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, copies) of every row, and (source, source_size, target). ``row``: a column of row numbers, kept as ``row``."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), number.alias("row"))
    rows = stored(rows, "mix-rows")
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")
    tilt = tilts(sizes, targets)
    # Full sources take everything twice; elsewhere the rate depends on source and size only.
    t = targets.join(tilt.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = F.col("target") >= MOST_COPIES * F.col("source_size")
    rates = sizes.join(few(t).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "n", F.when(F.col("size") == 0, 0.0).when(full, float(MOST_COPIES)).otherwise(F.round(rate(F.col("tilt"), F.col("size"), F.col("mean")), 9)).alias("rate"),
    )
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # The row number lets rows that are equal otherwise go to several ranges.
    places = ranked(rows, [F.col("source").asc_nulls_first(), F.col("size"), F.col("doc_id"), F.col("row")], "mix-ranked", "_rank")
    firsts = places.groupBy("source", "size").agg(F.min("_rank").alias("_first"))
    # Exact sums: the rates have nine digits.
    sums = rates.withColumn("_before", F.coalesce(F.sum((F.col("rate").cast(_EXACT) * F.col("n")).cast(_EXACT)).over(before), F.lit(0).cast(_EXACT)))
    plan = stored(_same(sums, firsts).select("source", "size", "rate", "_before", "_first"), "mix-rates")
    d = _same(places, few(plan))
    at = F.col("_rank") - F.col("_first")
    upto = lambda k: F.floor(F.col("_before") + F.col("rate").cast(_EXACT) * k + F.lit(0.5).cast(_EXACT))
    copies = (upto(at + 1) - upto(at)).cast("int")
    return d.select("doc_id", "source", "size", "row", copies.alias("copies")), targets


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on source and size, where null sources are equal."""
    r = right.withColumnsRenamed({"source": "_s", "size": "_z"})
    return left.join(r, left["source"].eqNullSafe(r["_s"]) & (left["size"] == r["_z"])).drop("_s", "_z")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    found, targets = decisions(docs)
    t = few(targets.select(F.col("source").alias("_s"), "source_size", "target"))
    d = found.join(t, F.col("source").eqNullSafe(F.col("_s")))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def copies(docs: DataFrame) -> DataFrame:
    """The mixed table: every row as often as it is taken, with the columns of ``docs``."""
    row = free_name(docs, "_vl_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    found, _ = decisions(rows, row)
    k = found.where("copies > 0").select(F.col("row").alias("_vl_taken"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_vl_copy"))
    return rows.join(k, rows[row] == k["_vl_taken"]).select(*[rows[f"`{c}`"] for c in docs.columns])
