"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each document, shuffled by a hash of its id, gets a virtual finish time: the words of its source up to and with it, divided by the source's target.
All are ordered by that time and cut off where the words taken would exceed the total budget. Both running sums are taken in two levels, over
ranges of the order and then within each range, so that no task holds a whole source or the whole queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, id_order, saved, table, text_of

#: Weights of the sources in code point order, repeating; and how often a document may be taken at most.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Ranges of virtual time for each time unit, when the queue is cut.
TICKS = 4096
#: The source table is broadcast up to this many sources; beyond it the join is a plain one.
SMALL = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: source, source_no, source_size, source_docs, target, total.

    Targets share the total of all sizes by weight; none is above ``repeats`` times its source's size, and the excess is shared again by weight. In
    order of the level at which each would be full, sources are filled for as long as the level that the rest allows is above their own.
    """
    one = Window.orderBy("source_no")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    every = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("weight", weight.cast("bigint")).withColumn("total", F.sum("source_size").over(every))
    per = per.withColumn("full_at", (F.col("source_size") * repeats).cast("double") / F.col("weight"))
    before = Window.orderBy("full_at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full_at", "source_no").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(every)
    per = per.withColumn("at", reached)
    filled = F.col("at").isNull() | (F.struct("full_at", "source_no") < F.struct(F.col("at.full_at"), F.col("at.source_no")))
    target = F.when(filled, (F.col("source_size") * repeats).cast("double")).otherwise(F.col("at.level") * F.col("weight"))
    return per.select("source", "source_no", "source_size", "source_docs", target.alias("target"), "total")


def _range_of(order: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal ranges of a 60-bit number it lies in."""
    return F.shiftright(F.shiftright(order, 30) * ranges, 30)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each document: row_id, doc_id, source, size, source_size, target, times, taken, finish.

    ``size`` is the number of words (null text: 0), ``times`` how often the mix takes the document (0 to ``repeats``), ``taken`` = size * times, and
    ``finish`` the virtual finish time of its first copy, by which the mix is ordered (null in a source without words). Documents without words are
    never taken. Null sources form one source, the last. Ties in the shuffle go by id, then size; of rows alike in both, each is queued on its own.
    An empty table gives no rows. Other columns are not read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = saved(
        docs.select(row.alias("row_id"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"), id_order(F.col(id_col)).alias("ord")), "mix-sizes"
    )
    sources = saved(source_targets(sized, weights, repeats), "mix-sources")
    side = F.broadcast(sources) if sources.count() <= SMALL else sources
    joined = sized.join(side, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    queued = joined.withColumn("range_no", _range_of(F.col("ord"), F.ceil(F.sqrt("source_docs")).cast("bigint")))

    sums = queued.groupBy("source_no", "range_no").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("source_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "range_no", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("source_no", "range_no").orderBy("ord", F.col("doc_id").asc_nulls_first(), "size", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = queued.join(starts, ["source_no", "range_no"]).withColumn("upto", F.col("range_start") + F.sum("size").over(within))
    queued = saved(queued.drop("range_start", "range_no", "source_docs"), "mix-queue")

    copies = queued.filter("size > 0").select("*", F.explode(F.array(*[F.lit(p).cast("bigint") for p in range(repeats)])).alias("copy"))
    copies = copies.withColumn("time", (F.col("copy") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    copies = copies.withColumn("tick", F.least(F.floor(F.col("time") * TICKS), F.lit(TICKS * repeats)).cast("bigint"))
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("tick_size"), F.max("total").alias("budget"))
    ticks = ticks.withColumn("tick_end", F.sum("tick_size").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = ticks.filter("tick_end > budget").agg(F.min(F.struct("tick", (F.col("tick_end") - F.col("tick_size")).alias("before"))).alias("cut"))
    # One row, whatever the input.
    at = F.broadcast(cut.select(F.col("cut.tick").alias("cut_tick"), F.col("cut.before").alias("cut_before")))
    marked = copies.join(at, F.lit(True))
    whole = marked.filter("cut_tick is null or tick < cut_tick").select("row_id", F.lit(1).alias("took"))
    order = Window.partitionBy("cut_tick").orderBy("time", "source_no", "ord", F.col("doc_id").asc_nulls_first(), "size", "row_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marked.filter("tick = cut_tick").withColumn("end", F.col("cut_before") + F.sum("size").over(order))
    last = last.filter("end <= total").select("row_id", F.lit(1).alias("took"))
    taken = whole.unionByName(last).groupBy("row_id").agg(F.sum("took").alias("times"))
    times = F.coalesce(F.col("times"), F.lit(0)).cast("bigint")
    return queued.join(taken, "row_id", "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), F.when(F.col("target") > 0, F.col("upto").cast("double") / F.col("target")).alias("finish")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: each document as often as it is taken, with its own columns only."""
    row = fresh(docs.columns, "row_id")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    took = mix(numbered, row_col=row).filter("times > 0").select(F.col("row_id").alias("mix_row"), "times", "finish", (F.col("source_size") / F.col("target")).alias("round"))
    own = [F.col(f"d.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    copies = numbered.alias("d").join(took.alias("m"), F.col(f"d.{row}") == F.col("m.mix_row")).select(*own, "m.mix_row", "m.finish", "m.round", F.explode(F.sequence(F.lit(0), F.col("m.times").cast("int") - 1)).alias("copy"))
    return copies.orderBy(F.col("finish") + F.col("copy") * F.col("round"), "mix_row", "copy").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ord
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
), w AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), f AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS full_at FROM w
), l AS (
  SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY full_at, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY full_at, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), k AS (
  SELECT full_at, source_no, level FROM l WHERE level <= full_at ORDER BY full_at, source_no LIMIT 1
), t AS (
  SELECT l.source, l.source_no, l.source_size, l.total,
         CASE WHEN k.level IS NULL OR l.full_at < k.full_at OR (l.full_at = k.full_at AND l.source_no < k.source_no)
              THEN CAST(3 * l.source_size AS DOUBLE) ELSE k.level * l.weight END AS target
  FROM l LEFT JOIN k ON TRUE
), q AS (
  SELECT d.doc_id, d.size, d.ord, t.source_no, t.source_size, t.target, t.total,
         CAST(sum(d.size) OVER (PARTITION BY t.source_no ORDER BY d.ord, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, p.copy, CAST(p.copy * source_size + upto AS DOUBLE) / target AS time
  FROM q, (SELECT unnest([0, 1, 2]) AS copy) p WHERE size > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY time, source_no, ord, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS upto_all FROM c
), n AS (
  SELECT doc_id, count(*) AS times FROM r WHERE upto_all <= total GROUP BY doc_id
)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CAST(q.size * coalesce(n.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id
"""
