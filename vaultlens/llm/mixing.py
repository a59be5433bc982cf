"""Mixing sources to target weights, as subset-sum budget fitting on the documents' exact sizes.

Targets share the whole by weight; a target stops at ``max_epochs`` times its source's size and the excess is reshared
by weight among the others until none is above.  A source's target is then met by whole passes over the source plus a
subset for the remaining budget: its documents are counted by exact size, every size is thinned in proportion (rounded
down), what is then missing is filled from the largest sizes down while it exceeds a bound that doesn't depend on the
corpus, and a bounded-knapsack dynamic programme over the sizes still available fits the rest.  Which documents of a size
are taken is a seeded order of their ids.

Only (source, size, count) rows meet in one task for a source, never its documents.  The seeded order is ranked within
slices of about ``slice_rows`` documents of a size, with the slices' counts summed before, so that a size which a third
of all documents share is ranked in many tasks.

Defined results: a null text has size 0; sources are ordered by code point with null last; weights repeat over them in
that order; documents of size 0 are taken as often as their source has whole passes; repeated rows are documents of
their own, those of one id being taken or left together; an empty table gives no rows; other columns never take part:
repeat_sources keeps them, mix_sources leaves out those that are called like what it adds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import use_shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Budgets up to this many words go to the dynamic programme.
FIT_WORDS = 65_536
#: Plan rows that may be broadcast; beyond, the join is a salted shuffle.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Runs without ASCII white space: their starts are the places where a blank, or the start, comes before."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each size to take, at most counts[i], for a sum as near below budget as the steps find."""
    sizes_, left = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    take = np.zeros(len(sizes_), np.int64)
    whole = int((sizes_ * left).sum())
    if budget <= 0 or whole == 0:
        return take.tolist()
    if budget >= whole:
        return np.where(sizes_ > 0, left, 0).tolist()
    # thin every size in proportion, in whole numbers
    take = np.array([int(c) * budget // whole if s else 0 for s, c in zip(sizes_.tolist(), left.tolist(), strict=True)], np.int64)
    rest = budget - int((sizes_ * take).sum())
    order = np.argsort(-sizes_, kind="stable")
    for i in order:  # from the largest down, until the rest is small
        if rest <= FIT_WORDS:
            break
        if sizes_[i]:
            more = min(int(left[i] - take[i]), max(0, (rest - FIT_WORDS + int(sizes_[i]) - 1) // int(sizes_[i])), rest // int(sizes_[i]))
            take[i] += more
            rest -= more * int(sizes_[i])
    return (take + _knapsack(sizes_, left - take, rest)).tolist()


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the most of budget that at most counts[i] of sizes[i] sum to.  Sums are the bits of an integer."""
    out, mask = np.zeros(len(sizes), np.int64), (1 << (budget + 1)) - 1
    reached, steps = 1, []
    for i in np.argsort(-sizes, kind="stable"):
        size, count, part = int(sizes[i]), int(counts[i]), 1
        if not size or size > budget:
            continue
        count = min(count, budget // size)
        while count > 0 and not reached >> budget & 1:  # binary splitting: 1, 2, 4, ... and a remainder
            part = min(part, count)
            steps.append((i, size, part, reached))
            reached |= reached << size * part & mask
            count -= part
            part *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    for i, size, part, before in reversed(steps):
        if not before >> at & 1:
            out[i] += part
            at -= size * part
    return out


def targets(sources: list[tuple[str | None, int]], weights: Sequence[int], max_epochs: int) -> list[float]:
    """The target of each (source, size), in the order given; weights repeat over it."""
    share = [float(weights[i % len(weights)]) for i in range(len(sources))]
    total = float(sum(size for _, size in sources))
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sources)) if i not in fixed]
        rest, by = total - sum(fixed.values()), sum(share[i] for i in free)
        want = {i: rest * share[i] / by for i in free}
        above = [i for i in free if want[i] > max_epochs * sources[i][1]]
        if not above:
            return [fixed.get(i, want.get(i, 0.0)) for i in range(len(sources))]
        fixed |= {i: float(max_epochs * sources[i][1]) for i in above}


def _aims(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size, target) of sources(source, source_size): the rule of targets(), on a table.

    A source's weight goes by its place in the whole order: places within ranges, and the ranges' counts before.
    """
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()).checkpoint()
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # one a partition
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part int, before long")
    place = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    shares = dealt.join(F.broadcast(offsets), "part").select("source", "source_size", share.alias("share")).checkpoint()
    cap = (F.col("source_size") * max_epochs).cast("double")
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    want, capped = F.lit(0.0), F.lit(False)
    while True:  # a round caps at least one source more
        fixed, by, n = shares.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("share"))), F.lit(0.0)), F.count(F.when(~capped, 1))).first()
        if not n:
            break
        want = F.lit(total - fixed) * F.col("share") / F.lit(by)
        if shares.where(~capped & (want > cap)).isEmpty():
            break
        capped = capped | (want > cap)
    return shares.select("source", "source_size", F.when(capped, cap).otherwise(want).alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, size, n_docs, source_size, target, passes, take): passes over all documents, and take of a size once more.

    docs(source, size).  The sources stay a table.
    """
    counted = docs.groupBy("source", "size").agg(F.count("*").alias("n_docs"))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size")).checkpoint()
    aims = _aims(sources, weights, max_epochs)
    aimed = counted.alias("l").join(aims.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_size", "r.target")

    def per_source(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size", ignore_index=True)
        size, aim = int(own["source_size"].iloc[0]), float(own["target"].iloc[0])
        passes = min(max_epochs, int(aim // size)) if size else 1
        budget = round(aim) - passes * size if passes < max_epochs and size else 0
        take = fit_budget(own["size"].tolist(), own["n_docs"].tolist(), budget)
        return own.assign(passes=passes, take=take)

    schema = "source string, size long, n_docs long, source_size long, target double, passes int, take long"
    return aimed.groupBy("source").applyInPandas(per_source, schema)


def _same() -> Column:
    return F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size"))


def _with_plan(left: DataFrame, right: DataFrame, few: bool, salts: int) -> DataFrame:
    """left and its plan row: a broadcast of counted few rows, else a join salted over the documents of a key.

    left: source, size and doc_id, beside other columns of any name if these are in a struct.
    """
    if few:
        return left.alias("l").join(F.broadcast(right.alias("r")), _same(), "left")
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.alias("l").join(right.hint("merge").alias("r"), _same() & (F.col("l.salt") == F.col("r.salt")), "left")


#: What mix_sources adds; columns of the documents that are called so are left out.
ADDED = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, slice_rows: int, salts: int, broadcast_rows: int) -> DataFrame:
    """row (a struct of all columns of docs) and the columns ADDED."""
    use_shared_dir(docs.sparkSession)
    sized = docs.select("source", n_words(F.col("text")).alias("size"), "doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # Sizes and ids, without texts, are counted and ranked: written once, so that texts are read twice in all.
    known = sized.select("source", "size", "doc_id").checkpoint()
    plan = plan_mix(known.select("source", "size"), weights, max_epochs)
    # Read several times: written once, so that the fitting isn't repeated and survives lost executors.
    plan = plan.withColumn("slices", F.ceil(F.col("n_docs") / slice_rows)).checkpoint()
    few = plan.count() <= broadcast_rows
    thinned = plan.where((F.col("take") > 0) & (F.col("take") < F.col("n_docs")))
    ids = (
        _with_plan(known, thinned, few, salts)
        .where(F.col("r.take").isNotNull())
        .select("l.source", "l.size", "l.doc_id", "r.take", draw.alias("draw"), F.pmod(draw, F.col("r.slices")).alias("slice"))
    )
    slices = ids.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("source", "size", "slice", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # the slice of each size in which its last taken document stands, and that document
    own = W.partitionBy("source", "size", "slice").orderBy("draw", "doc_id")
    ranked = ids.select("source", "size", "slice", "take", "draw", "doc_id", F.row_number().over(own).alias("place"))
    last = F.col("l.slice").eqNullSafe(F.col("r.slice")) & (F.col("l.place") + F.col("r.before") == F.col("l.take"))
    cuts = ranked.alias("l").join(slices.alias("r"), _same() & last).select(
        "l.source", "l.size", F.col("l.slice").alias("cut_slice"), F.col("l.draw").alias("cut_draw"), F.col("l.doc_id").alias("cut_id")
    )
    plan = plan.alias("l").join(cuts.alias("r"), _same(), "left").select("l.*", "r.cut_slice", "r.cut_draw", "r.cut_id").checkpoint()
    slice_ = F.pmod(draw, F.col("r.slices"))
    at = F.struct(slice_.alias("a"), draw.alias("b"), F.col("l.doc_id").alias("c"))
    cut = F.struct(F.col("r.cut_slice").alias("a"), F.col("r.cut_draw").alias("b"), F.col("r.cut_id").alias("c"))
    more = F.when(F.col("r.take") <= 0, 0).when(F.col("r.take") >= F.col("r.n_docs"), 1).otherwise((at <= cut).cast("int"))
    copies = F.col("r.passes") + more
    return _with_plan(sized, plan, few, salts).select("l.row", "l.size", "r.source_size", "r.target", copies.alias("copies"), (copies * F.col("l.size")).alias("taken"))


def mix_sources(
    docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, slice_rows: int = 256, salts: int = 16,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies times size); a document not taken has copies 0.

    docs(doc_id, text, source, ...).  Texts are never shuffled while the plan has few rows.
    """
    mixed = _mixed(docs, weights, max_epochs, seed, slice_rows, salts, broadcast_rows)
    return mixed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ADDED), *ADDED)


def repeat_sources(
    docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, slice_rows: int = 256, salts: int = 16,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The mix itself: every row of docs, with all its columns and no others, as often as the mix takes it."""
    mixed = _mixed(docs, weights, max_epochs, seed, slice_rows, salts, broadcast_rows).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(f"row.`{c}`") for c in docs.columns))
