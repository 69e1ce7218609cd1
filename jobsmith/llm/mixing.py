"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source has a token target. The document rates that meet all targets and stay closest (in
Fermi entropy, because no rate may pass ``cap``) to an even mix are exponentially tilted:
``rate = cap / (1 + exp(-theta_source * size / scale_source))``. The dual in theta is convex and is
solved by distributed Newton steps: documents are first counted by (source, size), each step sums
the tokens and their slope over those counts and moves theta, kept inside a bracket. Sums are
taken over integers, so reruns give the same theta whatever the task order.

Rates become whole copies: the floor of the rate, and one more for the documents whose drawn
number (md5 of id and text) lies lowest against the fraction of the rate, until the source's
target is reached (whole copies only: the last one may overshoot, if that comes nearer). Where that line falls is found by counting tokens in ``BUCKETS`` buckets of the
draw; only the rows of the bucket it falls in are ordered. A few further rounds give the words
still missing to smaller documents, so the taken words end near the target.

Cases: null text or a text without words has size 0 and is never taken; the null source is one
source, ranked last; repeated rows (all columns equal) are one unit and get the same copies; an
empty table gives an empty result; a source whose target is ``cap`` times its size is taken
``cap`` times; documents with a null id are mixed like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsmith.llm.common import hash52, small_side, staged, text_of, word_count
from jobsmith.session import drop_staged

BUCKETS = 4096
FIXED_POINT = float(2**30)
_EXACT = "decimal(38,0)"


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], cap: float) -> DataFrame:
    """``src, source_size, target`` from ``src, source, source_size``: shares by weight, held to
    ``cap`` times the source's size, the excess reshared by weight until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # sources reach their cap in the order of most / weight; the level where shares fit is water-filling
    rise = Window.orderBy("fill", "src")
    filled = (ranked.withColumn("fill", F.col("most") / F.col("weight"))
              .withColumn("capped", F.coalesce(F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
              .withColumn("level", (F.col("all") - F.col("capped")) / F.col("open")))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "src", "level"))).over(Window.partitionBy())
    level = first["level"]
    return filled.select("src", "source", "source_size",
                         F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _rate(theta: Column, size: Column, scale: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(-theta * size / scale))


def balance(counts: DataFrame, targets: DataFrame, cap: float, max_steps: int = 40, tol: float = 1e-5) -> DataFrame:
    """``src, source_size, target, scale, theta``: the dual solution by Newton steps over (src, size, n)."""
    size, n = F.col("size").cast(_EXACT), F.col("n").cast(_EXACT)
    scales = counts.groupBy("src").agg((F.sum((size * size * n).cast(_EXACT)) / F.sum((size * n).cast(_EXACT)))
                                       .cast("double").alias("scale"))
    state = staged(targets.join(scales, "src").select(
        "src", "source_size", "target", F.coalesce(F.when(F.col("scale") > 0, F.col("scale")), F.lit(1.0)).alias("scale"),
        F.lit(0.0).alias("theta"), F.lit(-4096.0).alias("low"), F.lit(4096.0).alias("high"), F.lit(1.0).alias("gap")), "mix-dual")
    for _ in range(max_steps):
        rate = _rate(F.col("theta"), F.col("size"), F.col("scale"), cap)
        tokens = (F.round(rate * F.lit(FIXED_POINT)).cast("decimal(20,0)") * F.col("size").cast("decimal(12,0)")).cast(_EXACT)
        slope = (F.round(rate * (1 - rate / F.lit(float(cap))) * F.col("size") / F.col("scale") * F.lit(FIXED_POINT))
                 .cast("decimal(25,0)") * F.col("size").cast("decimal(12,0)")).cast(_EXACT)
        sums = (counts.join(small_side(state, 10_000), "src").groupBy("src")
                .agg((F.sum((tokens * n).cast(_EXACT)).cast("double") / FIXED_POINT).alias("now"),
                     (F.sum((slope * n).cast(_EXACT)).cast("double") / FIXED_POINT).alias("slope")))
        low = F.when(F.col("now") < F.col("target"), F.col("theta")).otherwise(F.col("low"))
        high = F.when(F.col("now") < F.col("target"), F.col("high")).otherwise(F.col("theta"))
        step = F.col("theta") + (F.col("target") - F.col("now")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        gap = F.abs(F.col("now") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        settled = gap <= tol
        before, state = state, staged(state.join(sums, "src", "left").select(
            "src", "source_size", "target", "scale", low.alias("low"), high.alias("high"), "theta", "now", "slope",
            F.coalesce(gap, F.lit(0.0)).alias("gap"), settled.alias("settled"))
            .withColumn("theta", F.when(F.coalesce("settled", F.lit(True)), F.col("theta")).when(inside, step)
                        .otherwise((F.col("low") + F.col("high")) / 2))
            .select("src", "source_size", "target", "scale", "theta", "low", "high", "gap"), "mix-dual")
        drop_staged(before)
        # a source at its cap (or at 0) has no finite theta; its rate is within tol at the bracket's end
        if state.filter((F.col("gap") > tol) & (F.col("high") - F.col("low") > 1e-9)).isEmpty():
            break
    return state


def _fill(units: DataFrame, needs: DataFrame) -> DataFrame:
    """Grant one more copy to the units with the lowest draws while the source's words last."""
    open_units = (units.join(small_side(needs, 10_000), "src", "left")
                  .withColumn("can", ~F.col("more") & (F.col("rest") < 1) & (F.col("words") > 0) & (F.col("words") <= F.col("need")))
                  .withColumn("bucket", F.floor((F.col("draw") + 1) / 2 * F.lit(BUCKETS)).cast("int")))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (open_units.filter("can").groupBy("src", "bucket").agg(F.sum("words").alias("sum"))
               .withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))))
    marked = open_units.join(buckets, ["src", "bucket"], "left")
    whole = F.col("can") & (F.col("before") + F.col("sum") <= F.col("need"))
    edge = F.col("can") & ~whole & (F.col("before") < F.col("need"))
    inner = Window.partitionBy("src", "bucket").orderBy("draw", "id", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    columns = units.columns
    rest = marked.filter(~F.coalesce(edge, F.lit(False))).withColumn("more", F.col("more") | F.coalesce(whole, F.lit(False)))
    cut = (marked.filter(edge).withColumn("so_far", F.sum("words").over(inner))
           .withColumn("more", F.col("before") + F.col("so_far") <= F.col("need")))
    return rest.select(*columns).unionByName(cut.select(*columns))


def _nearest(units: DataFrame, needs: DataFrame) -> DataFrame:
    """Where words are still missing, the smallest unit that overshoots by less than that is taken too."""
    open_units = units.join(small_side(needs, 10_000), "src")
    over = ~F.col("more") & (F.col("rest") < 1) & (F.col("words") > F.col("need")) & (F.col("words") < 2 * F.col("need"))
    chosen = staged(open_units.filter(over).groupBy("src").agg(F.min(F.struct("words", "draw", "id", "row_hash")).alias("best")), "mix-nearest")
    best = F.col("best")
    hit = F.coalesce(F.col("id").eqNullSafe(best["id"]) & (F.col("row_hash") == best["row_hash"]), F.lit(False))
    return units.join(small_side(chosen, 10_000), "src", "left").withColumn("more", F.col("more") | hit).select(*units.columns)


def row_hash(docs: DataFrame) -> Column:
    """A hash of every column: rows that agree in it and in the id are repeated rows."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])


def mix_documents(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3.0, 1.0, 2.0), cap: int = 2,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rounds: int = 4) -> DataFrame:
    """One row per distinct row of ``docs``: ``id, row_hash, repeats, size, source, source_size, target, rate, copies``."""
    source = F.col(source_col).cast("string")
    light = (docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("row_hash"), source.alias("source"),
                         word_count(text_of(text_col)).alias("size"))
             .groupBy("id", "row_hash", "source", "size").agg(F.count(F.lit(1)).alias("repeats"))
             .withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))))
    light = staged(light, "mix-rows")
    counts = staged(light.groupBy("src", "source", "size").agg(F.sum("repeats").alias("n")), "mix-counts")
    sizes = counts.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = staged(source_targets(sizes, share, weights, cap), "mix-targets")
    dual = balance(counts.filter("size > 0").select("src", "size", "n"), targets.select("src", "source_size", "target"), cap)

    dual = dual.select("src", "theta", "scale")
    solved = staged(targets.join(dual, "src", "left"), "mix-solution")
    at_cap = F.col("target") >= F.col("source_size") * F.lit(float(cap)) * (1 - 1e-9)
    rate = (F.when(F.col("size") == 0, 0.0).when(at_cap, float(cap))
            .otherwise(F.round(_rate(F.col("theta"), F.col("size"), F.col("scale"), cap), 9)))
    drawn = hash52(F.concat_ws("|", F.col("id").cast("string"), F.col("row_hash"))) / F.lit(float(2**52))
    units = (light.join(small_side(solved.drop("source"), 10_000), "src")
             .withColumn("rate", rate).withColumn("base", F.least(F.floor("rate"), F.lit(cap)).cast("long"))
             .withColumn("words", F.col("size") * F.col("repeats"))
             .withColumn("draw", F.greatest(F.lit(-1.0), drawn - (F.col("rate") - F.col("base"))))
             .withColumn("rest", F.when(F.col("base") >= cap, 1.0).otherwise(0.0)).withColumn("more", F.lit(False)))
    units = staged(units, "mix-units")
    given = F.sum(F.col("words") * (F.col("base") + F.col("more").cast("long")))
    for _ in range(rounds):
        needs = staged(units.groupBy("src").agg((F.round(F.first("target")) - given).alias("need")), "mix-needs")
        before, units = units, staged(_fill(units, needs), "mix-units")
        drop_staged(before, needs)
    units = _nearest(units, staged(units.groupBy("src").agg((F.round(F.first("target")) - given).alias("need")), "mix-needs"))
    return units.select("id", "row_hash", "repeats", "size", "source", "source_size", "target", "rate",
                        (F.col("base") + F.col("more").cast("long")).alias("copies"))
