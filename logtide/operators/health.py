"""Chain summaries and ingest health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from logtide.operators.ingest import chain_state, count_duplicates


def chain_summary(chains: DataFrame, state: DataFrame, events: DataFrame) -> DataFrame:
    """Per configured chain (shortname, chain_id): cursors and last event id, by name.

    The last id counts rolled-back rows too.
    """
    last = events.groupBy("chain_id").agg(F.max("event_id").alias("last_event_id"))
    zero = F.lit(0).cast("long")
    return (
        chains.join(state, "chain_id", "left").join(last, "chain_id", "left")
        .select("shortname", "chain_id", F.coalesce("head", zero).alias("head_block"),
                F.coalesce("finalized", zero).alias("finalized_block"),
                F.coalesce("last_event_id", zero).alias("last_event_id"))
        .orderBy("shortname")
    )


def ingest_health(arrivals: DataFrame, blocks: DataFrame, state: DataFrame, orphans: DataFrame,
                  now: int) -> DataFrame:
    """Events stored, duplicates skipped, blocks replaced, cursors and lag per chain.

    Lag is -1 before the first event.
    """
    on = ["chain_id"]
    newest = (
        arrivals.groupBy("chain_id").agg(F.max("block_number").alias("number"))
        .join(blocks.select("chain_id", "number", "block_ts"), ["chain_id", "number"], "left")
        .select("chain_id", (F.lit(now) - F.col("block_ts")).alias("lag"))
    )
    replaced = orphans.groupBy("chain_id").agg(F.count(F.lit(1)).alias("replaced"))
    zero = F.lit(0).cast("long")
    return (
        state.join(count_duplicates(arrivals), on, "left").join(replaced, on, "left").join(newest, on, "left")
        .select("chain_id", F.coalesce("ingested", zero).alias("events_ingested"),
                F.coalesce("duplicates", zero).alias("events_deduped"),
                F.coalesce("replaced", zero).alias("blocks_replaced"),
                F.col("head").alias("head_block"), F.coalesce("finalized", zero).alias("finalized_block"),
                F.coalesce("lag", F.lit(-1)).cast("long").alias("lag_seconds"))
    )


#: What a batch adds to the health of a chain.
COUNTS = T.StructType([T.StructField("chain_id", T.IntegerType()), T.StructField("received", T.LongType()),
                       T.StructField("ingested", T.LongType()), T.StructField("newest", T.LongType())])


def batch_counts(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Counters of one batch: logs that came, logs that were new, the highest block among these."""
    came = arrivals.groupBy("chain_id").agg(F.count(F.lit(1)).alias("received"))
    new = stored.groupBy("chain_id").agg(F.count(F.lit(1)).alias("ingested"), F.max("block_number").alias("newest"))
    return came.join(new, "chain_id", "left").select(
        "chain_id", "received", F.coalesce("ingested", F.lit(0).cast("long")).alias("ingested"), "newest")


def from_counts(counts: DataFrame, rollbacks: DataFrame, blocks: DataFrame, finality_depth: int, now: int) -> DataFrame:
    """Health per chain out of the counters of all batches: a few rows for each batch, whatever the log holds.

    ``rollbacks`` has (chain_id, blocks) for each reorganisation. Lag is -1 before the first event.
    """
    on, zero = ["chain_id"], F.lit(0).cast("long")
    sums = counts.groupBy("chain_id").agg(F.sum("received").alias("received"), F.sum("ingested").alias("ingested"),
                                          F.max("newest").alias("newest"))
    times = blocks.select("chain_id", F.col("number").alias("newest"), "block_ts")
    lagged = sums.join(times, ["chain_id", "newest"], "left")
    replaced = rollbacks.groupBy("chain_id").agg(F.sum("blocks").alias("blocks"))
    return chain_state(blocks, finality_depth).join(lagged, on, "left").join(replaced, on, "left").select(
        "chain_id", F.coalesce("ingested", zero).alias("events_ingested"),
        F.coalesce(F.col("received") - F.col("ingested"), zero).alias("events_deduped"),
        F.coalesce("blocks", zero).alias("blocks_replaced"), F.col("head").alias("head_block"),
        F.coalesce("finalized", zero).alias("finalized_block"),
        F.coalesce(F.lit(now) - F.col("block_ts"), F.lit(-1)).cast("long").alias("lag_seconds"))
