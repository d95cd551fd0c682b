"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target of words. The whole part of target / size of the source
is allocated to each of its documents as certain copies. The rest is filled by
one more copy of some documents, drawn with unequal inclusion probabilities: p
grows with the square root of a document's size (taken per half octave of sizes),
so that long documents, few and hard to draw, come in more evenly; where that
reaches 1 the copy is certain too. The factor is such that the words expected are
the words missing. All others get the ranking variable (u / (1 - u)) / (p / (1 -
p)), u uniform from a hash of the document, and the smallest are taken until the
size of the sample, in words, is reached; one further document, whose size is
nearest to what then is missing, fills up.

No source is sorted as a whole. The logarithm of the ranking variable falls into
buckets of about BUCKET documents, words are summed per bucket, and only the
bucket in which the target is reached is sorted; every document is then decided
by comparing its rank with the limit of its source, without moving its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, small_join, spread_join, stored, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES = 1.5, 2
BUCKET = 1000
SEED = 20


def _sized(docs: DataFrame) -> DataFrame:
    """`docs` with _source (never null) and _size in words instead of source and text."""
    return (
        docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
        .withColumn("_size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
        .withColumn("_like", F.xxhash64("doc_id", "_source", "_size"))
        .drop("source", "text")
    )


def _drawn(sized: DataFrame, again: DataFrame) -> DataFrame:
    """`sized` with the uniform _u; rows that repeat an id, source and size draw by their row too."""
    told = spread_join(sized, again.select("_like", F.lit(True).alias("_again")), "_like", "left")
    own = F.when(F.col("_again"), F.col("_at")).otherwise(F.lit(-1).cast("long"))
    random = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("_size"), own), F.lit(1 << 52))
    return told.withColumn("_u", (random + F.lit(0.5)) / F.lit(float(1 << 52))).drop("_again", "_like")


def targets(measured: DataFrame) -> DataFrame:
    """Per source: docs, source_size, target.

    Sources in code point order, null last, weigh WEIGHTS in turn. A target
    stops at MOST_COPIES times the size; what is left over goes to the others by
    weight. With sources in ascending order of cap / weight, the level of water
    is where the first cap lies above it.
    """
    sizes = measured.groupBy("_source").agg(F.count("*").alias("docs"), F.sum("_size").alias("source_size"))
    order = Window.orderBy((F.col("_source") == "").cast("int"), "_source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double")
    all_rows, earlier = Window.partitionBy(), Window.orderBy("ratio", "_source").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(MOST_COPIES))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(Window.orderBy("ratio", "_source")))
        .withColumn("wanted", SHARE * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("wanted") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
        .withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(all_rows))
    )
    free = F.col("place") >= F.col("water.place")
    target = F.when(free, F.least(F.col("water.level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return levels.select("_source", "docs", "source_size", target.alias("target"))


def _band() -> Column:
    """Half octaves of sizes; documents without words lie below all."""
    return F.when(F.col("_size") > 0, F.floor(2 * F.log2(F.col("_size").cast("double")))).otherwise(F.lit(-1)).cast("int")


def chances(measured: DataFrame, of: DataFrame) -> DataFrame:
    """Per _source and _band: chance (inclusion probability of one more copy), and `open`, the words left to bands below 1.

    `of` has the words `missing` per source; documents larger than that have no
    chance, and are counted in no band. With bands in falling order of weight,
    the factor is right where the first band stays below 1.
    """
    fitting = F.col("_size") <= F.col("missing")
    bands = small_join(measured, of.select("_source", "missing"), "_source").withColumn("_band", _band()).groupBy("_source", "_band").agg(
        F.count_if(fitting).alias("fits"), F.sum(F.when(fitting, F.col("_size")).otherwise(F.lit(0))).alias("words"), F.first("missing").alias("missing")
    )
    bands = bands.withColumn("weight", F.coalesce(F.sqrt(F.try_divide("words", "fits")), F.lit(0.0)))
    falling = Window.partitionBy("_source").orderBy(F.desc("weight"), F.desc("_band"))
    above, rest = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = bands.withColumn("left", F.col("missing") - F.coalesce(F.sum("words").over(above), F.lit(0)))
    levels = levels.withColumn("factor", F.try_divide(F.col("left"), F.sum(F.col("weight") * F.col("words")).over(rest))).withColumn("place", F.row_number().over(falling))
    fits = F.when(F.col("factor") * F.col("weight") < 1, F.struct("place", "factor", F.greatest("left", F.lit(0.0)).alias("left")))
    levels = levels.withColumn("first", F.min(fits).over(Window.partitionBy("_source")))
    chance = F.when(F.col("place") < F.col("first.place"), F.lit(1.0)).otherwise(F.greatest(F.col("first.factor") * F.col("weight"), F.lit(0.0)))
    unfilled = F.col("missing") - F.sum("words").over(Window.partitionBy("_source"))
    return levels.select("_source", "_band", F.when(F.col("words") > 0, F.coalesce(chance, F.lit(1.0))).otherwise(F.lit(0.0)).alias("chance"),
                         F.coalesce("first.left", F.greatest(unfilled, F.lit(0.0))).alias("open"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows of a chance below 1 with the Pareto ranking variable, infinite for a chance of 0, and the bucket of its logarithm.

    The logarithm of odds of a uniform variable spreads at most a quarter of the
    documents over one unit, and dividing by the odds of the chance only shifts it.
    """
    chance = F.when(F.col("_size") <= F.col("missing"), F.col("chance")).otherwise(F.lit(0.0))
    ranking = F.col("_u") / (1 - F.col("_u")) / (F.col("chance") / (1 - F.col("chance")))
    drawn = (F.col("chance") > 0) & (F.col("chance") < 1)
    bucket = F.floor(F.log(F.col("ranking")) * F.ceil(F.col("docs") / BUCKET) / 8).cast("long")
    ranked = rows.withColumn("chance", chance).withColumn("ranking", F.when(drawn, ranking))
    ranked = ranked.withColumn("bucket", F.when(drawn, bucket))
    return ranked.withColumn("ranking", F.when((F.col("chance") == 0) & (F.col("_size") > 0), F.lit(float("inf"))).otherwise(F.col("ranking")))


def _mark() -> Column:
    """A rank that no two rows share."""
    return F.struct("ranking", F.col("doc_id").alias("id"), "_size", F.col("_at").alias("at"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (doc_id, _at, _source, _size, _u) of all `docs` (doc_id, source, text, _at); repeated ids; per source and band the chance and limits."""
    sized = stored(_sized(docs.select("doc_id", "source", "text", "_at")), "sizes")
    again = stored(sized.groupBy("_like").count().filter("count > 1").select("_like"), "repeated")
    measured = stored(_drawn(sized, again), "drawn")
    of = targets(measured).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    of = stored(of.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    by_band = stored(of.join(chances(measured, of), "_source", "left"), "chances")
    ranked = _ranked(_with_chance(measured, by_band)).filter("bucket is not null")
    words = ranked.groupBy("_source", "bucket").agg(F.sum("_size").alias("words"), F.first("open").alias("open"))
    before = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = stored(words.filter("before <= open").groupBy("_source").agg(F.max(F.struct("bucket", "before")).alias("edge")), "edges")
    edge = edge.select("_source", "edge.bucket", "edge.before")
    inside = small_join(ranked, edge, ["_source", "bucket"])
    upto = Window.partitionBy("_source").orderBy("ranking", "doc_id", "_size", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("reached", F.col("before") + F.sum("_size").over(upto)).filter("reached <= open")
    limits = reached.groupBy("_source").agg(F.max(_mark()).alias("limit"), F.max("reached").alias("reached"))
    limits = stored(by_band.join(edge.withColumnRenamed("bucket", "edge_bucket"), "_source", "left").join(limits, "_source", "left"), "limits")
    gap = F.col("open") - F.coalesce("reached", "before", F.lit(0))
    open_rows = _ranked(_with_chance(measured, limits)).filter("ranking is not null")
    fill = open_rows.filter(~_included() & (F.abs(gap - F.col("_size")) < gap)).groupBy("_source").agg(
        F.min(F.struct(F.abs(gap - F.col("_size")).alias("off"), _mark().alias("mark"))).getField("mark").alias("fill")
    )
    return measured, again, stored(limits.join(fill, "_source", "left"), "limits")


def _with_chance(measured: DataFrame, by_band: DataFrame) -> DataFrame:
    """Rows with the columns of their source and band; a source without words has no band and no chance."""
    return small_join(measured.withColumn("_band", _band()), by_band, ["_source", "_band"], "left")


def _included() -> Column:
    """The rank lies in an earlier bucket than the edge, or in it and within the limit."""
    return F.coalesce((F.col("bucket") < F.col("edge_bucket")) | ((F.col("bucket") == F.col("edge_bucket")) & (_mark() <= F.col("limit"))), F.lit(False))


def _with_copies(measured: DataFrame, limits: DataFrame) -> DataFrame:
    rows = _ranked(_with_chance(measured, limits))
    certain = F.coalesce(F.col("chance") >= 1, F.lit(False))
    extra = certain | (F.col("ranking").isNotNull() & (_included() | F.coalesce(_mark() == F.col("fill"), F.lit(False))))
    return rows.withColumn("_copies", (F.coalesce("whole", F.lit(0)) + extra.cast("int")).cast("int"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs` (doc_id, source, text).

    Null texts have no words; null sources form a source of their own. Rows that
    repeat an id are decided each for itself; a rerun takes as many of them. Empty
    tables give no rows; other columns are ignored.
    """
    measured, _, limits = plan(docs.withColumn("_at", F.monotonically_increasing_id()))
    of = limits.select("_source", "source_size", "target").distinct()
    rows = small_join(_with_copies(measured, limits).drop("source_size", "target"), of, "_source")
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it (never, once or twice).

    Documents without words are in no mix. Nulls, repeated rows and empty tables
    as in `mixed`; columns of any name stay as they are.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), "doc_id", "source", "text", F.monotonically_increasing_id().alias("_at"))
    packed = stored(packed.select("_given", "_at"), "numbered")
    named = packed.select("_given", "_given.doc_id", "_given.source", "_given.text", "_at")
    _, again, limits = plan(named)
    rows = _with_copies(_drawn(_sized(named), again), limits).filter("_copies > 0 and _size > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_given.*")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))
