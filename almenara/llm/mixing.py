"""Mix sources to target weights with hash-threshold histograms.

Every source gets a target: its weight's share of all words, at most ``MAX_EPOCHS`` times its own words, the excess
shared out again by weight until none is above. A target of r times the source's words takes every document
floor(r) times, and once more those whose hash lies under a threshold.

The threshold is found without sorting. Words are summed by source and the first ``STEP`` bits of the documents'
hashes; running sums give the bucket in which the budget ends; only that bucket is cut again by the next bits,
``LEVELS`` times. Documents are then filtered where they lie. Histograms have at most sources x 2**STEP rows; a
source with a third of all rows is summed on the map side like any other.

The rows of the last bucket share ``STEP * LEVELS`` bits: usually one row, or rows of equal id and text. Of them as
many are taken as come nearest to the budget, each if over half of it fits. Many equal rows are numbered by the task
that read them: tasks are counted, running totals over the tasks say how much of the budget each may still take.

Sizes are runs of characters other than white space; null text has size 0 and its hash is that of no text. Sources go
by code point, null last and a source of its own. Sources without words have target 0. Which of several equal rows
(id and text) are taken once more is open, their number is not. An empty table gives an empty mix. ``copies``
replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almenara.llm.columns import count_between, first_bits, small
from almenara.session import pin

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
STEP = 12
LEVELS = 4
BROADCAST_SOURCES = 20_000
SEPARATORS = r"[\x20\x09-\x0D]+"


def place(key: str, text: str) -> Column:
    """A document's place on the scale of thresholds, 0 to 2**48 - 1."""
    return first_bits(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))), STEP * LEVELS)


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Key, source, size in words and place of each document."""
    return documents.select(F.col(key), F.col(source).alias("source"), count_between(F.col(text), SEPARATORS).alias("size"), place(key, text).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its words, target, whole passes and the budget left for one more."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, so these windows are as small as the list of sources.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    named = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * MAX_EPOCHS
    fuller = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = fuller.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = named.withColumn("ratio", cap.cast("double") / F.col("weight")).withColumn("level", level)
    # Sources below the level are full; the first that is not sets it.
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.least(cap.cast("double"), F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))
    out = ranked.withColumn("target", target)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.select("source", "source_size", "target", passes.alias("passes")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``edge``, the place at which the budget ends, ``before``, the words below it, and ``edge_rows`` there."""
    n = goal.count()
    state = goal.withColumn("edge", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for level in range(LEVELS):
        rest = STEP * (LEVELS - 1 - level)
        now = small(state.select(F.col("source").alias("_source"), F.col("edge").alias("_edge")), n, BROADCAST_SOURCES)
        inside = sizes.join(now, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("place", rest + STEP) == F.col("_edge")))
        histogram = inside.groupBy("source", F.shiftright("place", rest).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("_rows"))
        running = histogram.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        ends = running.select(F.col("source").alias("_s"), "bucket", F.col("words").alias("_words"), "_rows", "upto")
        cut = ends.join(small(state, n, BROADCAST_SOURCES), F.col("_s").eqNullSafe(F.col("source"))).withColumn("_after", F.col("before") + F.col("upto"))
        cut = cut.filter((F.col("_after") > F.col("budget")) & (F.col("_after") - F.col("_words") <= F.col("budget")))
        found = cut.select("_s", "bucket", (F.col("_after") - F.col("_words")).alias("_before"), "_rows")
        # A source with no words has no bucket: nothing of it is taken.
        state = pin(goal.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            *goal.columns, F.coalesce("bucket", F.lit(-1)).alias("edge"), F.coalesce("_before", F.lit(0)).alias("before"), F.coalesce("_rows", F.lit(0)).alias("edge_rows")
        ))
    return state


def plan(sizes: DataFrame) -> DataFrame:
    """Source, its words and target, whole passes and threshold; ``sizes`` should be cheap to read again."""
    return thresholds(sizes, pin(targets(sizes)))


def decided(rows: DataFrame, goal: DataFrame, source: str = "source", size: str = "size", place: str = "place") -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``, how often each is taken; ``goal`` is their ``plan``."""
    own = goal.select(F.col("source").alias("_source"), "source_size", "target", "passes", "budget", "edge", "before", "edge_rows")
    n, most = goal.agg(F.count(F.lit(1)), F.coalesce(F.max("edge_rows"), F.lit(0))).first()
    joined = rows.join(small(own, n, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("_source")))
    out = [*rows.columns, "source_size", "target"]

    def taken(upto: Column) -> Column:
        return F.col("passes") + F.when(2 * upto - F.col(size) < 2 * F.col("budget"), 1).otherwise(0)

    alone = F.when(F.col(place) < F.col("edge"), F.col("passes") + 1).when(F.col(place) > F.col("edge"), F.col("passes")).otherwise(taken(F.col("before") + F.col(size)))
    if most <= 1:
        return joined.select(*out, alone.alias("copies"))
    at_edge = (F.col(place) == F.col("edge")) & (F.col("edge_rows") > 1)
    # Row numbers are stored with the rows, so that a task that runs again decides alike.
    edge = pin(joined.filter(at_edge).withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)))
    tasks = edge.groupBy("_source", "_task").agg(F.sum(size).alias("_words"))
    tasks = pin(tasks.select(
        F.col("_source").alias("_s"), F.col("_task").alias("_t"), (F.sum("_words").over(Window.partitionBy("_source").orderBy("_task")) - F.col("_words")).alias("_base")
    ))
    numbered = edge.withColumn("_upto", F.sum(size).over(Window.partitionBy("_source", "_task").orderBy("_row")))
    numbered = numbered.join(small(tasks, tasks.count(), BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    shared = numbered.select(*out, taken(F.col("before") + F.col("_base") + F.col("_upto")).alias("copies"))
    return joined.filter(~at_edge).select(*out, alone.alias("copies")).unionByName(shared)


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``documents`` with ``copies``: how often the mix takes each, 0 to ``MAX_EPOCHS``."""
    documents = documents.drop("copies")
    goal = plan(pin(sized(documents, key, text, source)))
    # Clashing names are kept apart by packing the row.
    packed = documents.select(
        F.struct(*documents.columns).alias("_doc"), F.col(source).alias("_own"), count_between(F.col(text), SEPARATORS).alias("_size"), place(key, text).alias("_place")
    )
    return decided(packed, goal, "_own", "_size", "_place").select("_doc.*", "copies")
