"""Mixing sources to target weights by Pareto order sampling (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Rank buckets of a source: prefix sums run over these, and only one bucket is ever put in order.
BUCKETS = 16_384

def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, get the weights in turn.  Targets share ``share`` of all sizes
    by weight, and none is over ``cap`` times its source's size: with sources in order of cap by
    weight, the first ones are held at their caps for as long as the level of the rest is above
    that ratio.  One row for each source meets in one task.
    """
    in_turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    w = sizes.withColumn("_k", F.row_number().over(in_turn) - 1).withColumn("_w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_k") % n + 1).cast("int")))
    w = w.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    w = w.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    w = w.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_k"), F.col("_level")))).over(Window.partitionBy())["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return w.select("source", "source_size", target.alias("target"))


def _uniform(*cols: F.Column) -> F.Column:
    """A number in (0, 1) that depends on the row's values alone: the first 52 bits of an MD5 digest."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rank(seed: str) -> F.Column:
    """Random odds divided by inclusion odds, mapped to (0, 1); null where nothing is left to chance."""
    u = _uniform(F.lit(seed), F.col("doc_id"), F.col("source"))
    q = u / (1 - u) / (F.col("_p") / (1 - F.col("_p")))
    return F.when(F.col("_p") > 0, q / (1 + q))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")


def sampling_plan(sized: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row for each source: its size and target, its certain copies, and where its Pareto sample ends.

    ``sized`` has ``doc_id, source, size``.  Sums by rank bucket find the bucket in which a source's sample
    ends, and only the rows of that bucket are put in order, so a source with a third of all rows
    is never sorted in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sums, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_sure", F.floor(ratio).cast("long")).withColumn("_p", ratio - F.col("_sure"))
    plan = materialize(plan.withColumn("_rest", F.col("target") - F.col("_sure") * F.col("source_size")), "mix-targets")
    # Ranks are written once, so that the plans below hold a column where they held its digests again and again.
    ranked = _with_plan(sized, plan).where("_p > 0").select("source", "doc_id", "size", "_rest", _rank(seed).alias("_rank"))
    rows = materialize(ranked.withColumn("_bucket", F.floor(F.col("_rank") * BUCKETS)), "mix-ranks")
    by_bucket = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = by_bucket.withColumn("_upto", F.sum("_n").over(upto))
    edge = by_bucket.where(F.col("_upto") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_e"))
    edge = materialize(edge.select("source", F.col("_e._bucket").alias("_edge"), F.col("_e._before").alias("_before")), "mix-edges")
    # In the last bucket: the last rank that fits, and the gap that it leaves.
    in_order = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = _with_plan(rows, edge).where("_bucket = _edge").withColumn("_cum", F.col("_before") + F.sum("size").over(in_order))
    last = inside.groupBy("source").agg(F.max(F.when(F.col("_cum") <= F.col("_rest"), F.struct("_rank", "_cum"))).alias("_l"), F.first("_before").alias("_b"), F.first("_rest").alias("_r"), F.first("_edge").alias("_edge"))
    last = materialize(last.select("source", "_edge", F.coalesce(F.col("_l._rank"), F.lit(-1.0)).alias("_last"), (F.col("_r") - F.coalesce(F.col("_l._cum"), F.col("_b"))).alias("_gap")), "mix-last")
    # What is outside the sample, in rank order: whatever fits; then the one exchange that comes closest.
    outside = _with_plan(rows.where("size > 0"), last).where((F.col("_bucket") >= F.col("_edge")) & (F.col("_rank") > F.col("_last")))
    outside = materialize(outside.select("source", "size", "_rank", _class(F.col("size")).alias("_class")), "mix-outside")
    gaps = _close_gaps(outside, last)
    sampled = _with_plan(_with_plan(rows.where("size > 0"), edge.select("source", "_edge")), gaps).where((F.col("_bucket") < F.col("_edge")) | (F.col("_rank") <= F.col("_last")) | _in_steps())
    swaps = materialize(_exchange(sampled, _with_plan(outside, gaps).where(~_in_steps()), gaps), "mix-swaps")
    plan = _with_plan(_with_plan(_with_plan(plan, edge), gaps), swaps)
    return materialize(plan.select("source", "source_size", "target", "_sure", "_p", "_edge", "_last", "_steps", "_leaves", "_comes"), "mix-plan")


def _exchange(sampled: DataFrame, outside: DataFrame, gaps: DataFrame) -> DataFrame:
    """``source, _leaves, _comes``: ranks of the sampled document that leaves and of the one that comes for it, either of which may be none (-1).

    Of all such pairs it is the one that brings the words closest to the target; sources where none does
    better than nothing have no row.  Each size stands for its documents (the first rank), and the sizes of a source
    are put in order in one task: for a size that leaves, the best to come are the next ones below and above it plus the gap.
    """
    nothing = gaps.select("source", F.lit(0).cast("long").alias("size"), F.lit(-1.0).alias("_rank"))
    sizes = lambda rows: rows.select("source", "size", "_rank").unionByName(nothing).groupBy("source", "size").agg(F.min("_rank").alias("_rank"))
    gap = gaps.select("source", "_gap")
    leave = _with_plan(sizes(sampled), gap).select("source", (F.col("size") + F.col("_gap")).alias("_v"), F.col("_rank").alias("_out"), F.lit(None).cast("struct<size:long,rank:double>").alias("_in"))
    come = sizes(outside).select("source", F.col("size").cast("double").alias("_v"), F.lit(None).cast("double").alias("_out"), F.struct("size", F.col("_rank").alias("rank")).alias("_in"))
    by_size = Window.partitionBy("source").orderBy("_v", F.col("_out").isNotNull())
    below, above = by_size.rowsBetween(Window.unboundedPreceding, 0), by_size.rowsBetween(0, Window.unboundedFollowing)
    pairs = leave.unionByName(come).withColumn("_near", F.array(F.last("_in", True).over(below), F.first("_in", True).over(above))).where("_out is not null")
    pairs = pairs.select("source", "_v", "_out", F.explode("_near").alias("_in")).where("_in is not null")
    best = pairs.groupBy("source").agg(F.min(F.struct(F.abs(F.col("_in.size") - F.col("_v")).alias("off"), F.col("_out").alias("leaves"), F.col("_in.rank").alias("comes"))).alias("_b"))
    return _with_plan(best, gap).where(F.col("_b.off") < F.abs("_gap")).select("source", F.col("_b.leaves").alias("_leaves"), F.col("_b.comes").alias("_comes"))


def _close_gaps(outside: DataFrame, last: DataFrame) -> DataFrame:
    """``source, _last, _gap, _steps``: what else of ``source, size, _rank, _class`` is taken, for each row of ``source, _last, _gap``.

    A step goes on in rank order over documents of the classes below the gap's own, as long as they
    fit.  They are smaller than the gap, and the one that ends the step is larger than what is left of it,
    so the gap's class falls with each step: there are at most as many steps as the gap has bits, and then
    no document of a lower class is left.  Sums by bucket find where a step ends, as for the sample itself.
    """
    state = last.select("source", "_last", "_gap", F.col("_last").alias("_lo"), F.lit(True).alias("_open"), F.array().cast(_STEPS).alias("_steps"))
    outside = outside.withColumn("_bucket", F.floor(F.col("_rank") * BUCKETS))
    while True:
        state = state.withColumn("_most", _class(F.floor("_gap")) - 1)
        fits = _fitting(outside, state.where("_open"))
        sums = fits.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"), F.max("_rank").alias("_top"), F.first("_gap").alias("_gap"))
        upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_below", F.max("_top").over(before))
        ends = sums.groupBy("source").agg(F.min(F.when(F.col("_upto") > F.col("_gap"), F.struct("_bucket", "_before", "_below"))).alias("_e"), F.max("_upto").alias("_all"), F.max("_top").alias("_top"))
        state = materialize(_with_plan(state, ends), "mix-ends")
        found = F.col("_all").isNotNull()
        if state.where(found).isEmpty():
            return state.select("source", "_last", "_gap", "_steps")
        in_order = Window.partitionBy("source").orderBy("_rank").rangeBetween(Window.unboundedPreceding, 0)
        inside = _fitting(outside, state.where("_e is not null")).where("_bucket = _e._bucket").withColumn("_cum", F.col("_e._before") + F.sum("size").over(in_order))
        inside = inside.groupBy("source").agg(F.max(F.when(F.col("_cum") <= F.col("_gap"), F.struct("_rank", "_cum"))).alias("_l"))
        hi = F.when(F.col("_e").isNull(), F.col("_top")).otherwise(F.coalesce("_l._rank", "_e._below"))
        taken = F.when(F.col("_e").isNull(), F.col("_all")).otherwise(F.coalesce("_l._cum", "_e._before"))
        step = F.struct(F.col("_most").alias("most"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
        state = _with_plan(state, inside).withColumns({"_hi": hi, "_taken": taken})
        # A step that takes nothing has no end, and is the last of its source.
        found = F.col("_hi").isNotNull()
        state = state.select(
            "source", "_last", (F.col("_gap") - F.when(found, F.col("_taken")).otherwise(0)).alias("_gap"), F.coalesce("_hi", "_lo").alias("_lo"), found.alias("_open"), F.when(found, F.array_append("_steps", step)).otherwise(F.col("_steps")).alias("_steps")
        )
        state = materialize(state, "mix-steps")


def _fitting(outside: DataFrame, state: DataFrame) -> DataFrame:
    """The documents that a step goes over, with the columns of its source's state."""
    return _with_plan(outside, state.drop("_last", "_open", "_steps")).where((F.col("_rank") > F.col("_lo")) & (F.col("_class") <= F.col("_most")))


#: What a step takes: documents of classes up to ``most``, with ranks over ``lo`` and up to ``hi``.
_STEPS = "array<struct<most:int,lo:double,hi:double>>"


def _class(size: F.Column) -> F.Column:
    """The size's highest bit; that of 0 is 0."""
    return F.length(F.bin(size)) - 1


def _in_steps() -> F.Column:
    return F.exists("_steps", lambda s: (_class(F.col("size")) <= s["most"]) & (F.col("_rank") > s["lo"]) & (F.col("_rank") <= s["hi"]) & (F.col("size") > 0))


def apply_plan(rows: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Add ``source_size, target, copies, taken`` to rows with ``doc_id, source, size``; joins one row for each source."""
    rows = _with_plan(rows, plan).withColumn("_rank", _rank(seed))
    sampled = F.col("_rank").isNotNull() & (F.col("_edge").isNull() | (F.floor(F.col("_rank") * BUCKETS) < F.col("_edge")) | (F.col("_rank") <= F.col("_last")) | F.coalesce(_in_steps(), F.lit(False)))
    sampled = (sampled & (F.coalesce(F.col("_leaves"), F.lit(-1.0)) != F.col("_rank"))) | (F.col("_comes") == F.col("_rank"))
    copies = (F.col("_sure") + F.coalesce(sampled, F.lit(False)).cast("long")).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return rows.drop("_rank", "_sure", "_p", "_edge", "_last", "_steps", "_leaves", "_comes")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """``docs`` (with ``doc_id, text, source``) and ``size, source_size, target, copies, taken``; such columns are replaced.

    A document of a source with target/size ratio r gets floor(r) copies for certain.  The rest of
    the target is sampled without replacement: documents rank by u/(1-u) divided by p/(1-p), with
    p = r - floor(r) and u drawn from the id, the source and the seed, and are taken in that order
    while their sizes fit.  Those after the first that doesn't fit follow in the same order if they fit, by falling
    classes of size, until none is left that does.  At last one sampled document (or none) is exchanged for one outside
    (or none), if that comes closer to the target: the pair that comes closest.  Whole documents are taken:
    ``taken = copies * size``.

    The texts are read to count words and to be returned, and are never shuffled but for the join
    with one row for each source.  A null text has size 0; a source without words has the target 0;
    the null source is a source of its own; rows with equal id and source rank alike and are taken
    or left together, and if such rows don't fit, no step follows; an empty table gives no rows.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    base = docs.select(*(c for c in docs.columns if c.lower() not in made)).withColumn("size", word_count(F.col("text")))
    sized = materialize(base.select("doc_id", "source", "size"), "mix-sizes")
    return apply_plan(base, sampling_plan(sized, weights=weights, share=share, cap=cap, seed=seed), seed)
