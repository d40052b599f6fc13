"""Mixing sources to target weights along a curriculum whose weights change over time.

Every source has a weight schedule, a piecewise linear function of the training time t from 0 to 1.
Its integral is the source's weight, from which its target follows: sources share the corpus by weight,
no target exceeds ``max_repeats`` times its source, and the excess is shared again. A source's documents
form a stream in a fixed shuffled order, repeated until the target is met. The stream's cumulative
tokens, read against the source's cumulative demand (the integral of its schedule up to t), give
each copy its training position t. Sorting by position is one range shuffle.

The stream's running totals come in two steps, so that no source lands in one task: sums of (source,
bucket of the shuffle order), whose running totals are a small table, then totals within each bucket. There are so many
buckets that one has about ``BUCKET_ROWS`` rows, however large the source. Texts take no part in
this: they meet their positions by a join on a digest of the whole row, and are then sorted.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources or
tables without words have target 0; rows with equal ids are ordered by size, then by text; null ids are dealt by their text;
of rows that repeat in all columns each is a document of its own; an empty table gives no rows. Texts of any length are
read whole. Columns of type map take no part in the digest that tells rows with one id and text apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.llm.common import WORD, durable

MAX_REPEATS = 3
#: Rows of a bucket, about, and the least hexadecimal digits of the shuffle order that make one: 4,096 buckets a source.
BUCKET_ROWS, BUCKET_DIGITS = 20_000, 3

Schedule = Callable[[Column], Column]


def cycling_ramps(index: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the source's place in order; even places fall from 1.5 to 0.5 of their weight over time, odd ones rise."""
    weight = (index % 3 + 1).cast("double")
    slope = F.when(index % 2 == 0, F.lit(-0.5)).otherwise(F.lit(0.5))
    return F.array(
        F.struct(F.lit(0.0).alias("t"), (weight * (1 - slope)).alias("w")),
        F.struct(F.lit(1.0).alias("t"), (weight * (1 + slope)).alias("w")),
    )


def _integrals(knots: Column) -> Column:
    """The schedule's integral from 0 up to each knot."""
    steps = F.sequence(F.lit(1), F.size(knots) - 1)
    area = lambda i: (knots[i]["t"] - knots[i - 1]["t"]) * (knots[i]["w"] + knots[i - 1]["w"]) / 2
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + area(i))))


def _inverse(knots: Column, integrals: Column, demand: Column) -> Column:
    """The time at which the schedule's integral reaches demand: a quadratic within one segment."""
    k = F.least(F.greatest(F.size(F.filter(integrals, lambda c: c <= demand)), F.lit(1)), F.size(knots) - 1)
    a, b, c = knots[k - 1], knots[k], demand - integrals[k - 1]
    width = b["t"] - a["t"]
    slope = (b["w"] - a["w"]) / width
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * c, F.lit(0.0)))
    step = F.when(a["w"] + root > 0, 2 * c / (a["w"] + root)).otherwise(F.lit(0.0))
    return a["t"] + F.least(step, width)


def source_targets(sizes: DataFrame, schedule: Schedule = cycling_ramps, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds knots, integrals and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    out = out.withColumn("knots", schedule(F.col("place"))).withColumn("integrals", _integrals(F.col("knots")))
    out = out.withColumn("weight", F.element_at("integrals", -1))
    out = out.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    # sources reach their cap in the order of cap by weight; the level is right once no later source is above its cap
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    out = out.withColumn("level", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", "knots", "integrals", target.alias("target"))


def _row_key(docs: DataFrame, id_col: str) -> Column:
    """A digest of a whole row, with its id."""
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    return F.concat_ws("/", F.col(id_col).cast("string"), F.hex(F.xxhash64(*plain)), F.hex(F.hash(*plain)))


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("key"),
        F.xxhash64(text_col).alias("text_key"),
        _row_key(docs, id_col).alias("row_key"),
    )
    return durable(rows).withColumn("row", F.monotonically_increasing_id())  # of files that are written: the same each time


def _placed(rows: DataFrame, schedule: Schedule, max_repeats: int) -> DataFrame:
    """rows with source_size, target, takes and positions."""
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(1, rows.count()) / BUCKET_ROWS, 16)))
    turn = F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.col("text_key"))).cast("binary"))
    rows = rows.withColumn("turn", turn).withColumn("bucket", F.substring("turn", 1, digits))
    sums = durable(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedule, max_repeats)
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    sums = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select("key", "bucket", "bucket_start", "source_size", "knots", "integrals", "target")
    out = rows.join(sums, ["key", "bucket"])
    within = Window.partitionBy("key", "bucket").orderBy("turn", "id", "size", "text_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    quota = F.floor("target").cast("long")
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda j: F.col("start") + j * F.col("source_size"))
    starts = F.filter(starts, lambda s: (s < quota) & (F.col("size") > 0))
    whole = F.element_at("integrals", -1)
    return out.withColumns(
        {
            "takes": F.transform(starts, lambda s: F.least(F.col("size"), quota - s)),
            "positions": F.transform(starts, lambda s: _inverse(F.col("knots"), F.col("integrals"), whole * s / F.col("target"))),
        }
    )


def mix(docs: DataFrame, schedule: Schedule = cycling_ramps, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken, takes (words of each copy), positions (of each copy).

    taken is the sum of takes. A source's takes add up to its target, rounded down; so at most one copy
    a source is cut short.
    """
    out = _placed(_rows(docs, id_col, source_col, text_col), schedule, max_repeats)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "takes", "positions")


def curriculum(docs: DataFrame, schedule: Schedule = cycling_ramps, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """The mixed corpus in training order: the columns of docs, one row for each copy taken; position_col names a column to add with its position.

    A copy that is cut short has its first words, joined by one space.
    """
    rows = _rows(docs, id_col, source_col, text_col)
    placed = _placed(rows, schedule, max_repeats).where(F.size("takes") > 0)
    placed = placed.select("row", "row_key", "size", F.arrays_zip("takes", "positions").alias("copies"))
    doc = docs.select(_row_key(docs, id_col).alias("row_key"), F.struct(*(F.col(c) for c in docs.columns)).alias("doc"))
    on = ["row_key"]
    if not rows.groupBy("row_key").count().where("count > 1").isEmpty():  # rows that repeat as a whole, among which it does not matter which is which
        nth = F.row_number().over(Window.partitionBy("row_key").orderBy("row"))
        placed = placed.join(rows.select("row", nth.alias("nth")), "row")
        doc = doc.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(0))))
        on = ["row_key", "nth"]
    out = doc.join(durable(placed.drop("row")), on).select("row_key", "doc", "size", F.explode("copies").alias("copy"))
    words = F.slice(F.regexp_extract_all(F.col(f"doc.{text_col}"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("copy.takes").cast("int"))
    text = F.when(F.col("copy.takes") < F.col("size"), F.array_join(words, " ")).otherwise(F.col(f"doc.{text_col}"))
    more = [F.col("copy.positions").alias(position_col)] if position_col else []
    return out.orderBy("copy.positions", F.col("doc")[id_col], "row_key").select(*((text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns), *more)
