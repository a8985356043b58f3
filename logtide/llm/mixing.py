"""Mixing sources to target weights by weighted fair queueing (operator 4).

Documents of a source are shuffled by a hash of their id and repeat in that
order. A document's virtual finish time is its source's tokens up to and with it, divided by the
source's target. Sorted by finish time over all sources, the documents up to
the total budget are the mix: every source advances in step with its target.

Running sums are taken in two levels, so that no source and no table is
laid out in one task: rows go to cells of about ``CELL_ROWS`` rows by their
source and shuffle hash, cells are summed, and the sums before a cell are
added to those within it. The cut of the total order is found the same way: sums over
a grid of ``GRID`` steps of finish time, then over ranges of a global sort of the one step in which the budget ends.

A source's words are its documents' whole sizes. Null texts have size 0 and are never
taken, as are sources of size 0 (their target is 0). A null source is one of its own, last in
order. Rows that are equal in all ways share their turn in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.session import work_dir

WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
CELL_ROWS, GRID, RANGE_ROWS = 1_000, 4_096, 100_000


def words(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("bigint")


def shuffled(name: str = "doc_id") -> Column:
    return F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")))


def targets(sizes: DataFrame) -> DataFrame:
    """source, known, source_size, target of a table with a row for each source.

    Water filling: with level x a source gets min(2 * size, weight * x). Sources are full in the
    order of 2 * size / weight, so the level is the budget that is left, divided by the
    weights that are left, at the first source that this does not fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    levels = listed.select(
        "*", (SHARE * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(MOST_TIMES * F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    level = (F.col("budget") - F.col("full")) / F.col("rest")
    capped = levels.withColumn("level", level).withColumn("fills", F.col("weight") * F.col("level") >= MOST_TIMES * F.col("source_size"))
    final = F.min(F.when(~F.col("fills"), F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    return capped.withColumn("final", final).select(
        "source", "place", "source_size",
        F.when(F.col("final").isNull() | F.col("fills"), (MOST_TIMES * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("final.level")).alias("target"))


def _small(frame: DataFrame, name: str) -> DataFrame:
    folder = work_dir(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def queue(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their turn, targets).

    ``rows`` has source, size, turn_key (shuffle order, hexadecimal) and tie (further order). Adds place, source_size,
    target, and ``before``: the source's words ahead of the row in one pass.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = _small(per_source, "sources")
    goals = _small(targets(sources.select("source", "source_size")).join(
        sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    counted = rows.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    hashed = F.conv(F.substring("turn_key", 1, 8), 16, 10).cast("bigint")
    cells = F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL_ROWS))
    dealt = counted.withColumn("cell", F.floor(hashed * cells / F.lit(1 << 32)).cast("bigint")).drop("rows")
    sums = dealt.groupBy("place", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = F.sum("cell_size").over(Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("place", "cell", F.coalesce(ahead, F.lit(0)).alias("cell_before"))
    within = Window.partitionBy("place", "cell").orderBy("turn_key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    turned = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return turned.join(starts, ["place", "cell"]).withColumn("before", F.col("cell_before") + F.col("inner")), goals


def finish(turn: int) -> Column:
    """Virtual finish time of a row in pass ``turn``; null where it is never taken."""
    done = F.col("source_size") * turn + F.col("before") + F.col("size")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), done / F.col("target"))


def cut(queued: DataFrame, budget: int) -> tuple[float, int, str, str]:
    """(finish, place, turn_key, tie) of the last row that the budget takes whole.

    Rows are in order of finish time, then source, then turn. Nothing is taken if all is (-1, ...).
    """
    passes = queued.select("place", "turn_key", "tie", "size", F.explode(F.array(*[finish(t) for t in range(MOST_TIMES)])).alias("finish"))
    # past the latest time at which a source has had its target, one document further, the budget is used up
    largest = queued.filter("target > 0").groupBy("place").agg(F.max(F.col("size") / F.col("target")).alias("x")).agg(F.max("x")).first()[0]
    if largest is None or budget <= 0:
        return (-1.0, 0, "", "")
    step = (1.0 + largest) / GRID
    placed = passes.filter(F.col("finish").isNotNull()).withColumn("step", F.least(F.floor(F.col("finish") / step), F.lit(GRID + 1)))
    sums = placed.groupBy("step").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.orderBy("step"))
    crossing = sums.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("step").limit(1).collect()
    if not crossing:
        return (float("inf"), 0, "", "")
    last, left = crossing[0]["step"], budget - (crossing[0]["upto"] - crossing[0]["n"])
    return last_within(placed.filter(F.col("step") == last), left) or (float(last) * step, -1, "", "")


def last_within(rows: DataFrame, budget: int) -> tuple[float, int, str, str] | None:
    """Last row, in the mix's order, of those whose sizes up to and with it stay within ``budget``; None if none does.

    A global range sort in two levels: ranges of about ``RANGE_ROWS`` rows are summed, and only
    the range in which the budget ends is laid out by itself.
    """
    order = ["finish", "place", "turn_key", "tie"]
    ranges = max(1, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = _small(rows.select("size", *order).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "last-step")
    sums = laid.groupBy("range").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("range")))  # a row for each range
    crossing = sums.filter(F.col("upto") > budget).orderBy("range").limit(1).collect()
    whole = laid
    if crossing:
        end, left = crossing[0]["range"], budget - (crossing[0]["upto"] - crossing[0]["n"])
        inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        split = laid.filter(F.col("range") == end).withColumn("upto", F.sum("size").over(inside)).filter(F.col("upto") <= left)
        whole = laid.filter(F.col("range") < end).unionByName(split.select(laid.columns))
    taken = whole.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    return tuple(taken) if taken is not None else None


def times(last: tuple[float, int, str, str]) -> Column:
    """How often a row is in the mix, given the last one that is."""
    count = F.lit(0)
    names = ("finish", "place", "turn_key", "tie")
    end = F.struct(*[F.lit(x).alias(n) for x, n in zip(last, names)])
    for turn in range(MOST_TIMES):
        mine = F.struct(finish(turn).alias("finish"), "place", "turn_key", "tie")
        count = count + F.when(finish(turn).isNotNull() & (mine <= end), 1).otherwise(0)
    return count


def _queued(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), shuffled().alias("turn_key"),
                       F.hex(F.xxhash64("text")).alias("tie"), *more)


def _plan(docs: DataFrame) -> tuple[DataFrame, tuple[float, int, str, str]]:
    """(queued narrow rows, last row of the mix); sizes are written once, 60 bytes a row."""
    narrow = _small(_queued(docs), "sizes")
    queued, goals = queue(narrow)
    queued = _small(queued, "queued")
    budget = goals.agg(F.floor(F.sum("target") + 1e-6)).first()[0] or 0
    return queued, cut(queued, int(budget))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, times of every document."""
    queued, last = _plan(docs)
    return queued.withColumn("times", times(last)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, all columns kept.

    The decision is joined by id, text hash and source; rows equal in these are taken alike.
    """
    queued, last = _plan(docs)
    chosen = (queued.withColumn("times", times(last)).filter("times > 0")
              .groupBy(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie"), F.col("source").alias("mix_source"))
              .agg(F.max("times").alias("mix_times")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(chosen, [F.col("row.doc_id").eqNullSafe(F.col("mix_id")), F.hex(F.xxhash64("row.text")) == F.col("mix_tie"),
                              F.col("row.source").cast("string").eqNullSafe(F.col("mix_source"))])
    return kept.select("row", F.explode(F.sequence(F.lit(1), "mix_times"))).select("row.*")


#: The same mix as one statement for a single-node SQL engine.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - coalesce(2 * sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM w),
f AS (
  SELECT *, weight * level >= 2 * source_size AS fills FROM l),
g AS (
  SELECT source, place, source_size,
         CASE WHEN fills OR (SELECT count(*) FROM f WHERE NOT fills) = 0 THEN (2 * source_size)::DOUBLE
              ELSE weight * (SELECT level FROM f WHERE NOT fills ORDER BY source_size::DOUBLE / weight, place LIMIT 1) END AS target
  FROM f),
q AS (
  SELECT d.doc_id, d.turn_key, d.size, g.place, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY g.place ORDER BY d.turn_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (
  SELECT *, (source_size * t + upto)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1)) AS passes(t) WHERE size > 0 AND target > 0),
r AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, turn_key) AS total FROM p),
k AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r
  WHERE total <= (SELECT floor(sum(target) + 1e-6) FROM g) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken,
       CASE WHEN q.size = 0 THEN 0 ELSE coalesce(k.taken, 0) // q.size END AS times
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""
