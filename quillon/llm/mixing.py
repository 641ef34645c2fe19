"""Mixing sources to target weights by entropy balancing.

Each document d gets a rate w(d), its expected number of copies. Among all rates between 0 and the limit that meet the token
constraint of its source, sum of w(d) * size(d) = target, the rates nearest to 1 in relative entropy are w(d) = min(limit, exp(lambda * size(d))).
The dual is convex with one lambda for each source; distributed Newton iterations solve it on the histogram (source, size, documents),
which is all the dual depends on. Rates are then rounded into whole copies by carrying the rounding error from large documents to
small ones, within buckets of a bounded number of documents. A source's documents are numbered in order of size and dealt to its buckets in turn, so that a hot source, and any number of
rows of one doc_id and size, are spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, placed, release, written

#: Documents in a rounding bucket at most, and in a partition of those that are numbered, about.
BUCKET, PLACED = 4096, 65_536


def token_size(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """(sid, source, n_docs, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total; a target above limit times its
    source's size is cut there and the excess goes to the others by weight. Cuts are found in one pass: in order of size by weight, a source
    is cut if it is below its share of what those before it left. One row a source passes through the ordered windows.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(weight, (F.col("sid") - 1) % len(weights) + 1))
    per = per.withColumn("cut", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cut") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("is_cut", F.col("cut") < F.col("weight") * left / rest)
    spare = F.sum("source_size").over(everything) - F.sum(F.when(F.col("is_cut"), F.col("cut")).otherwise(0.0)).over(everything)
    share = F.sum(F.when(~F.col("is_cut"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("is_cut") | (share == 0), F.col("cut")).otherwise(F.least("cut", F.col("weight") * spare / F.when(share > 0, share)))
    return per.select("sid", "source", "n_docs", "source_size", target.alias("target"))


def solve_rates(sizes: DataFrame, targets: DataFrame, limit: float = 3.0, tolerance: float = 1e-3, rounds: int = 100) -> DataFrame:
    """(sid, lambda): the dual solution of each source; null where every document takes the limit.

    sizes has (sid, size). A Newton step that leaves the bracket of a source is replaced by its midpoint, and from the twelfth round on every third step is a midpoint, so that every
    source converges; the loop ends when the largest relative miss of a target is below the tolerance. It is an error if that does not come about.
    """
    hist = written(sizes.where("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n")), "mix-hist")
    lim = F.lit(float(limit))
    base = hist.groupBy("sid").agg(F.min("size").alias("least"), F.sum(F.col("size") * F.col("n")).alias("total"))
    state = targets.join(base, "sid").where((F.col("target") < F.col("total") * lim * (1 - 1e-12)) & (F.col("target") > 0))
    ratio = F.col("target") / F.col("total")
    edge = F.log(lim) / F.col("least")
    low = F.least(F.log(ratio), F.lit(0.0)) / F.col("least")
    state = written(state.select("sid", "target", "total", low.alias("low"), edge.alias("high"), F.least(edge, F.greatest(low, F.log(ratio) / (F.col("total") / F.lit(1.0)))).alias("lambda")), "mix-state")
    for turn in range(rounds):
        x = F.col("size")
        tilt = F.exp(F.least(F.col("lambda") * x, F.log(lim)))
        mass = F.col("n") * x

        def exact(term: Column) -> Column:
            """A sum that does not depend on the order of its terms, so that reruns agree to the last bit."""
            return F.sum(term.cast("decimal(38,6)")).cast("double")

        found = (
            hist.join(state, "sid")
            .withColumn("w", tilt)
            .groupBy("sid", "target", "total", "low", "high", "lambda")
            .agg(exact(mass * F.col("w")).alias("value"), exact(F.when(F.col("w") < lim, mass * x * F.col("w")).otherwise(0.0)).alias("slope"))
        )
        miss = F.col("value") - F.col("target")
        found = found.withColumn("low", F.when(miss < 0, F.col("lambda")).otherwise(F.col("low"))).withColumn("high", F.when(miss > 0, F.col("lambda")).otherwise(F.col("high")))
        # Newton on the logarithm of the constraint, and on that of what is left to the limit, where most documents take it: whichever goes further up
        slope = F.when((F.col("slope") > 0) & (F.col("value") > 0), F.col("slope"))
        left, wanted = lim * F.col("total") - F.col("value"), lim * F.col("total") - F.col("target")
        step = F.col("lambda") - F.log(F.col("value") / F.col("target")) * F.col("value") / slope
        step = F.greatest(step, F.col("lambda") + F.log(left / F.when(wanted > 0, wanted)) * left / slope)
        inside = (step > F.col("low")) & (step < F.col("high")) & F.lit(turn < 12 or turn % 3 > 0)
        off = F.abs(miss) / F.col("target")
        after = F.when(off <= tolerance, F.col("lambda")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        before, state = state, written(found.select("sid", "target", "total", "low", "high", after.alias("lambda"), off.alias("off")), "mix-state")
        release(before)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"rates did not settle: a target is missed by {worst:.2%}")
    release(hist)
    return state.select("sid", "lambda")


def round_bucket(rows: pa.Table) -> pa.Table:
    """Round the rates of a bucket: from the largest document down, each takes the whole number next to its rate that best pays back the error so far."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])  # null ids last
    error, out = 0.0, []
    for size, rate in zip(rows["size"].to_numpy().astype(np.float64), rows["rate"].to_numpy(), strict=True):
        floor = float(np.floor(rate + 1e-9))
        up = min(floor + 1.0, float(np.ceil(rate - 1e-9)))
        take = up if size and (error + rate * size - floor * size) * 2 >= size * (up - floor) and up > floor else floor
        error += (rate - take) * size
        out.append(int(take))
    return rows.append_column("copies", pa.array(out, pa.int64()))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies) for every row of docs (doc_id, source, text).

    Null or empty texts have size 0, rate 1 and one copy. Null sources form one source, last in order. Repeated rows each get
    their own copies. An empty table gives an empty result. Other columns are ignored. Equal input gives equal output:
    buckets and order depend on doc_id and size only, and rows equal in both may be taken for each other. row: a column (long) of docs that is handed through.
    """
    own = [row] if row else []
    sizes = written(docs.select("doc_id", *own, "source", token_size(F.col("text")).alias("size")), "mix-sizes")
    targets = written(token_targets(sizes, weights, limit), "mix-targets")
    known = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", *own, "size", "sid", "source_size", "target")
    order = known.withColumn("_size", -F.col("size"))
    numbered = placed(order, "sid", ["_size", "doc_id"], sizes.count() // PLACED + 1, "mix-places").withColumn("bucket", F.col("pos") % F.ceil(F.col("n") / BUCKET).cast("long"))
    rates = solve_rates(numbered.select("sid", "size"), targets.select("sid", "target"), limit)
    lim = F.lit(float(limit))
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("target") <= 0, 0.0)
        .when(F.col("lambda").isNull(), lim)
        .otherwise(F.exp(F.least(F.col("lambda") * F.col("size"), F.log(lim))))
    )
    rated = numbered.join(rates, "sid", "left").select("doc_id", *own, "size", "source_size", "target", rate.alias("rate"), "sid", "bucket")
    schema = "doc_id long, size long, source_size long, target double, rate double, copies long" + "".join(f", {x} long" for x in own)

    def rounded(rows: pa.Table) -> pa.Table:
        return round_bucket(rows).select(["doc_id", "size", "source_size", "target", "rate", "copies", *own])

    return rated.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("sid", "bucket").applyInArrow(rounded, schema)
