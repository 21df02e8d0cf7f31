"""Mixing sources to target weights by entropy balancing (operator 7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running
from .storage import cut, unwrapped, wrapped

WORD = r"[^\x20\x09-\x0D]+"
#: The dual of a source from which nothing is taken.
NEVER = -50.0
#: Prior rates by size in words: (up to, rate); fragments and very long documents are repeated less readily than others.
PRIORS = ((63, 0.5), (2047, 1.0), (None, 0.7))
#: Sizes, as multiples of a source's mean, down to which each rounding step goes; the last takes the rest.
STEPS = (4.0, 1.0, 0.25, 0.0)
#: Tables of sources are broadcast if they have no more rows than this, and joined by shuffling beyond it.
MAX_BROADCAST = 20_000
#: Rates are rounded to this fraction, so that their running sums are exact and reruns agree.
UNIT = 1 << 30


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``target`` words for each row (source, source_size) of ``sources``.

    The sources take ``weights`` in turn, in code point order with null last.
    Together they get ``share`` of all words by weight; a source's target stops
    at ``most`` times its size and the excess goes to the others by weight,
    again until none is above. Each turn needs two sums over the sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running(sources, order, index="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, -1
    while True:
        capped = F.col("weight") * rate >= F.col("cap")
        now = rows.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("at_cap"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(capped).alias("full"),
        ).first()
        if now["full"] == full or not now["free"]:
            break
        rate, full = (total - now["at_cap"]) / now["free"], now["full"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(rate)).alias("target"))


def tilt(cells: DataFrame, most: float = 2.0, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """The entropy-balancing multiplier ``dual`` of each source.

    ``cells`` has (source, prior, size, target): the words of a source's
    documents with that prior rate, a few cells for each source. Rates min(most, prior * exp(dual)) are, of
    all rates up to ``most``, those nearest to the priors in relative entropy
    whose words sum to the target. The dual is convex and falls apart by source, so the
    Newton steps (on the logarithm of the words, which an exponential tilt makes
    straight below the cap) of all sources run side by side, each on its source's cells. A step is nothing once a source is within
    ``tolerance`` of its target. A source without words or target gets the dual ``NEVER``.
    """
    rate = f"least({float(most)}D, c.prior * exp(dual))"
    words = f"aggregate(cells, 0D, (sum, c) -> sum + c.size * {rate})"
    slope = f"aggregate(cells, 0D, (sum, c) -> sum + if(c.prior * exp(dual) < {float(most)}D, c.size * c.prior * exp(dual), 0D))"
    newton = "greatest(-2D, least(2D, ln(target / now.words) * if(now.slope > 0, now.words / now.slope, 1D)))"
    step = f"if(now.words <= 0 or abs(target - now.words) <= target * {tolerance!r}D, 0D, {newton})"
    solved = f"aggregate(sequence(1, {rounds}), 0D, (dual, i) -> dual + transform(array(struct({words} AS words, {slope} AS slope)), now -> {step})[0])"
    sources = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("prior", "size"))).alias("cells"), F.max(F.col("target").cast("double")).alias("target"))
    return cut(sources.select("source", F.expr(f"if(target > 0, {solved}, {NEVER}D)").alias("dual")))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", priors: Sequence[tuple[int | None, float]] = PRIORS,
) -> DataFrame:
    """How many times (0 to ``most``) each document enters the mix: (doc_id, size, source, source_size, target, rate, copies, key).

    Targets as in ``source_targets``. Rates are exponentially tilted from
    ``priors`` by size (``tilt``), so that within a source they keep the priors' proportions up to ``most``, and
    rounded into whole copies by systematic sampling: in each source, documents stand in order of falling size, and one has as many
    copies as whole numbers the running sum of rates passes in it. Large documents
    round first; the rates of the rest are then tilted again to meet what is left
    of the target, in ``STEPS`` steps down in size, so that a source misses its
    target by a few of its smallest documents.

    Null text or text without words: size 0, never taken (0 words either way). Null source: a source
    of its own, last. Repeated rows count each. No rows: no rows. ``key`` names a
    row for joining copies back: the id and a hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    ))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    targets = cut(source_targets(sources.drop("largest"), weights, share, float(most)).withColumnRenamed("source", "s"))
    on = F.col("source").eqNullSafe(F.col("s"))
    side = F.broadcast if targets.count() <= MAX_BROADCAST else lambda x: x
    prior = F.lit(float(priors[-1][1]))
    for upto, rate in reversed(priors[:-1]):
        prior = F.when(F.col("size") <= upto, float(rate)).otherwise(prior)
    left = sized.withColumn("prior", prior).join(side(targets), on).drop("s")
    duals = tilt(_cells(left, "prior", F.first("target")), float(most)).withColumnRenamed("source", "d")
    left = left.join(side(duals), F.col("source").eqNullSafe(F.col("d"))).withColumn("rate", F.least(F.lit(float(most)), F.col("prior") * F.exp("dual"))).drop("d", "dual", "prior")
    means = sized.filter("size > 0").groupBy("source").agg(F.avg("size").alias("mean")).withColumnRenamed("source", "m")
    left = cut(left.join(side(means), F.col("source").eqNullSafe(F.col("m")), "left").drop("m"))

    done = None
    for k, bound in enumerate(STEPS):
        now = left.filter(F.col("size") > F.col("mean") * bound) if bound else left
        units = F.round(F.col("rate") * UNIT).cast("long")
        summed = running(now, [-F.col("size"), F.col("key"), F.col("doc_id")], {"passed": units}, ["source"])
        whole = lambda x: F.shiftright(x + UNIT // 2, 30)
        rounded = cut(summed.withColumn("copies", (whole(F.col("passed") + units) - whole(F.col("passed"))).cast("int")).drop("passed", "row_index"))
        done = rounded if done is None else done.unionByName(rounded)
        if not bound:
            break
        rest = left.filter((F.col("size") <= F.col("mean") * bound) | F.col("mean").isNull())
        goals = rest.groupBy("source").agg(F.sum("size").alias("words"), F.first("target").alias("goal")).join(
            _decided(done), F.col("source").eqNullSafe(F.col("t")), "left")
        goals = goals.select(F.col("source").alias("n"), F.greatest(F.lit(0.0), F.least(F.col("words") * float(most), F.col("goal") - F.coalesce(F.col("taken"), F.lit(0)))).alias("goal"))
        cells = _cells(rest, "rate").join(side(goals), F.col("source").eqNullSafe(F.col("n"))).select("source", "prior", "size", F.col("goal").alias("target"))
        duals = tilt(cells, float(most)).withColumnRenamed("source", "n")
        rate = F.least(F.lit(float(most)), F.col("rate") * F.exp("dual"))
        left = cut(rest.join(side(duals), F.col("source").eqNullSafe(F.col("n"))).withColumn("rate", rate).drop("n", "dual"))
    return done.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", "key")


def _cells(rows: DataFrame, rate: str, *others) -> DataFrame:
    """(source, prior, size, [target]): the words of a source's documents with one rate; a source has a few rates, as many as there are priors."""
    return cut(rows.groupBy("source", F.col(rate).alias("prior")).agg(F.sum("size").cast("double").alias("size"), *[x.alias("target") for x in others]))


def _decided(done: DataFrame) -> DataFrame:
    """Words taken so far by source."""
    return done.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).withColumnRenamed("source", "t")


def take(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as many times as ``plan`` (from ``mix``) says."""
    copies = plan.groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    base = docs.select(wrapped(docs), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    joined = base.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key"))).filter("copies > 0").select("row", "id", "hash", "copies", "rows")
    # rows alike in id and text share their copies: each has the whole number of its part, the first ones the rest
    place = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))
    several = joined.filter("rows > 1").withColumn("copies", F.expr("copies div rows") + F.when(place <= F.col("copies") % F.col("rows"), 1).otherwise(0))
    return (
        joined.filter("rows = 1").unionByName(several).filter("copies > 0")
        .select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select(*unwrapped(docs.columns))
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate")
