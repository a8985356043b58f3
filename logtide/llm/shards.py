"""Sharding by minimax contiguous partition (operator 7), DataFrame functions only.

Atomic groups are equal texts, in order of the MD5 of the text. A shard is a stretch of
that order. The largest shard is as small as any such cut into ``shards``
stretches allows: a capacity is feasible if filling shards greedily, each as far
as it goes, needs no more than ``shards``; the smallest feasible one is searched.

Groups are summed before anything else, so a text that a third of all rows share is one
row. Prefix sums over the groups come in two levels (sums of ``DIGITS`` leading hex digits,
then within). One job answers the greedy's next step for ``TRIES`` capacities
at once, so each round narrows the search ``TRIES`` times; only those answers reach the driver.

Rows of a shard are numbered by (hash digits, salt, hash, id): counts of cells of about
``CELL_ROWS`` rows give each cell's first slot, and only a cell is numbered in
one task. A group of many rows spreads over the salts of its cell row.

Null texts have size 1 and are of one group with empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm import batches
from logtide.session import work_dir

SHARDS, DIGITS, TRIES, CELL_ROWS = 8, 3, 48, 1_000


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = work_dir(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group (MD5 of the text), written once (60 bytes a row)."""
    text = batches.text_or_empty()
    return _written(docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"),
                                F.crc32(text).alias("text_crc32"), F.md5(text).alias("group")), "digests")


def prefix_sums(rows: DataFrame) -> DataFrame:
    """group, size, upto (sizes of all groups up to and with it)."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("size")).withColumn("lead", F.substring("group", 1, DIGITS))
    groups = _written(groups, "groups")
    ahead = F.sum("n").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))  # at most 16 ** DIGITS rows
    leads = groups.groupBy("lead").agg(F.sum("size").alias("n")).select("lead", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("size").over(Window.partitionBy("lead").orderBy("group"))
    return _written(groups.withColumn("within", within).join(leads, "lead").select("group", "size", (F.col("ahead") + F.col("within")).alias("upto")), "prefix")


def reached(sums: DataFrame, bounds: list[int], largest: int) -> list[int]:
    """For each bound the greatest prefix sum at or below it (0 if none)."""
    near = sums.filter((F.col("upto") > min(bounds) - largest) & (F.col("upto") <= max(bounds)))
    found = near.agg(*[F.max(F.when(F.col("upto") <= b, F.col("upto"))).alias(f"b{i}") for i, b in enumerate(bounds)]).first()
    return [x or 0 for x in found]


def smallest_capacity(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Least capacity that ``shards`` stretches keep to, and the prefix sums at which they end."""
    total, largest = sums.agg(F.max("upto"), F.max("size")).first()
    if not total:
        return 0, [0] * shards
    # shards of total / shards + the largest group always do, and less than either never does
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    best, ends = high, None
    while low <= high:  # what is below ``low`` is known not to fit
        count = min(TRIES, high - low + 1)
        tried = sorted({low + (high - low) * i // max(1, count - 1) for i in range(count)})
        at = {c: [0] for c in tried}
        for _ in range(shards):
            short = [c for c in tried if at[c][-1] < total]
            if not short:
                break
            for c, end in zip(short, reached(sums, [at[c][-1] + c for c in short], largest)):
                at[c].append(end)
        fits = [c for c in tried if at[c][-1] == total]
        low = max([low - 1, *(c for c in tried if at[c][-1] < total)]) + 1
        if fits:
            best, ends, high = fits[0], at[fits[0]][1:], fits[0] - 1
    return best, ends + [total] * (shards - len(ends))


def cut_groups(sums: DataFrame, cuts: list[int]) -> list[str]:
    """Last group of every shard but the last; shorter if the groups end before."""
    rows = sums.filter(F.col("upto").isin([c for c in cuts if c])).select("upto", "group").collect()
    return [g for _, g in sorted((r.upto, r.group) for r in rows)][: len(cuts) - 1]


def shard_of(cuts: list[str]) -> Column:
    """Number of cuts before the group."""
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("group") > c).cast("int")
    return shard


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their slot: gapless from 0 in each shard."""
    lead = rows.withColumn("lead", F.substring("group", 1, DIGITS)).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    counts = lead.groupBy("shard", "lead").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each hash lead, and one more for each cut: a fixed bound
    leads = F.broadcast(counts.select("shard", "lead", "rows", F.coalesce(before, F.lit(0)).alias("lead_before")))
    salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL_ROWS))
    salt = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * salts / F.lit(1 << 32)).cast("bigint")
    dealt = lead.join(leads, ["shard", "lead"]).withColumn("salt", salt)
    cells = dealt.groupBy("shard", "lead", "salt").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard", "lead").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("shard", "lead", "salt", F.coalesce(ahead, F.lit(0)).alias("salt_before"))
    inner = F.row_number().over(Window.partitionBy("shard", "lead", "salt").orderBy("group", "key"))
    return (dealt.withColumn("inner", inner).join(starts, ["shard", "lead", "salt"])
            .withColumn("slot", F.col("lead_before") + F.col("salt_before") + F.col("inner") - 1))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, shard_bytes limit of every document."""
    rows = digests(docs)
    sums = prefix_sums(rows)
    capacity, cuts = smallest_capacity(sums, shards)
    placed = numbered(rows.withColumn("shard", shard_of(cut_groups(sums, cuts))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("bigint").alias("capacity"))
