"""Log scan, backfill planning, idempotent appends, blocks, cursors, chain state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logtide.schemas import EVENT_KEY
from logtide.session import sized

BACKFILL_CHUNK = 2000
ZERO_HASH = bytes(32)


def scan_logs(raw: DataFrame, topic0s: Iterable[str], start: int, end: int,
              contracts: DataFrame | None = None) -> DataFrame:
    """Logs of a block range with a known topic0, from the given contracts.

    The range filter reaches the scan; the topic filter, on an array's first
    element, is applied to the rows read. ``contracts`` (chain_id, address)
    is a semi join that Spark broadcasts only where its size allows.
    """
    logs = raw.where(F.col("block_number").between(start, end)
                     & F.get("topics", F.lit(0)).isin([bytes.fromhex(t) for t in topic0s]))
    if contracts is None:
        return logs
    return logs.join(contracts.select("chain_id", "address"), ["chain_id", "address"], "left_semi")


def scan_plan(raw: DataFrame, plan: DataFrame, topic0s: Iterable[str]) -> DataFrame:
    """Logs inside each contract's planned block range, all contracts in one job.

    The plan (one row per contract) is written first, so it has a size and the
    logs are not shuffled while it is small.
    """
    topics = [bytes.fromhex(t) for t in topic0s]
    ranges = sized(plan.select("chain_id", F.col("contract").alias("address"),
                               F.col("from_block").alias("_from"), F.col("to_block").alias("_to")), "scan-plan")
    # the plan's outer bounds as numbers: these reach the scan
    low, high = ranges.agg(F.min("_from"), F.max("_to")).first()
    inside_all = F.lit(False) if low is None else F.col("block_number").between(low, high)
    logs = raw.where(inside_all & F.get("topics", F.lit(0)).isin(topics)).alias("l")
    inside = ((F.col("l.chain_id") == F.col("p.chain_id"))
              & (F.col("l.address") == F.col("p.address"))
              & F.col("l.block_number").between(F.col("p._from"), F.col("p._to")))
    return logs.join(ranges.alias("p"), inside, "left_semi")


def plan_backfill(watched: DataFrame, cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """Block range still to scan per watched contract, earliest start first.

    ``heads`` is (chain_id, head). Contracts already past the head drop out.
    """
    position = cursors.select("chain_id", F.col("contract").alias("address"), "next_block")
    start = F.greatest(F.coalesce("next_block", F.lit(0)), "from_block")
    return (
        watched.join(position, ["chain_id", "address"], "left")
        .join(heads.select("chain_id", "head"), "chain_id")
        .select("chain_id", F.col("address").alias("contract"), "kind",
                start.alias("from_block"), F.col("head").alias("to_block"))
        .where(F.col("from_block") <= F.col("to_block"))
        .orderBy("from_block", "chain_id", "contract")
    )


def split_chunks(plan: DataFrame, size: int = BACKFILL_CHUNK) -> DataFrame:
    """Each planned range cut into pieces of ``size`` blocks, bounds inclusive."""
    starts = F.when(F.col("from_block") <= F.col("to_block"),
                    F.sequence("from_block", "to_block", F.lit(size).cast("long")))
    return (
        plan.withColumn("chunk_start", F.explode(starts))
        .withColumn("chunk_end", F.least(F.col("chunk_start") + size - 1, "to_block"))
    )


# --- first write wins ------------------------------------------------------

_HASH = "_key_hash"


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key, with a hash of the key in front.

    Whole rows aggregate by sorting. With a number of many values as the first grouping column that is a
    radix sort; keys that begin with a chain id or with zeros would be compared byte by byte.
    """
    payload = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return (
        rows.groupBy(F.xxhash64(*keys).alias(_HASH), *keys).agg(picked)
        .select(_HASH, *[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in payload])
        .select(_HASH, *rows.columns)
    )


def first_write(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate rather than a ranking window: copies of one key collapse
    inside each input task, so a key repeated in a large share of the rows
    never gathers in one place.
    """
    return _first(rows, keys, order).drop(_HASH)


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str],
             order: Sequence[str | Column]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, one per key; the join keeps the aggregate's partitioning."""
    known = stored.select(F.xxhash64(*keys).alias(_HASH), *keys)
    return _first(batch, keys, order).join(known, [_HASH, *keys], "left_anti").drop(_HASH)


def append_events(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events to append under the (chain, contract, block hash, log index) key."""
    if stored is None:
        return first_write(batch, EVENT_KEY, ["event_id"])
    return new_rows(batch, stored, EVENT_KEY, ["event_id"])


def count_duplicates(batch: DataFrame) -> DataFrame:
    """Rows received, stored and skipped per chain."""
    distinct_keys = batch.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("copies"))
    return distinct_keys.groupBy("chain_id").agg(
        F.sum("copies").alias("received"), F.count(F.lit(1)).alias("ingested"),
        (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"))


# --- blocks ----------------------------------------------------------------

def blocks_from_logs(events: DataFrame) -> DataFrame:
    """Block rows known from logs alone: no timestamp, no parent."""
    return (
        events.groupBy("chain_id", F.col("block_number").alias("number"),
                       F.col("block_hash").alias("hash"))
        .agg(F.max("event_id").alias("seq"))
        .select("chain_id", "number", "hash", F.lit(ZERO_HASH).alias("parent_hash"),
                F.lit(0).cast("long").alias("block_ts"), "seq")
    )


def _latest_known(column: str, known: Column) -> Column:
    return F.max(F.when(known, F.struct("seq", column)))[column].alias(column)


def latest_blocks(rows: DataFrame) -> DataFrame:
    """One row per height out of block rows with an arrival number ``seq``.

    The latest arrival decides the hash. Timestamp and parent come from the
    latest row of that hash that has them, so a row known from a log never
    blanks a header. Results merge again with further rows.
    """
    per_hash = rows.groupBy("chain_id", "number", "hash").agg(
        _latest_known("parent_hash", F.col("parent_hash") != F.lit(ZERO_HASH)),
        _latest_known("block_ts", F.col("block_ts") != 0), F.max("seq").alias("last_seq"))
    best = F.max_by(F.struct("hash", "parent_hash", "block_ts", "last_seq"), F.struct("last_seq", "hash")).alias("now")
    return per_hash.groupBy("chain_id", "number").agg(best).select(
        "chain_id", "number", F.col("now.hash").alias("hash"),
        F.coalesce("now.parent_hash", F.lit(ZERO_HASH)).alias("parent_hash"),
        F.coalesce("now.block_ts", F.lit(0)).alias("block_ts"), F.col("now.last_seq").alias("seq"))


def upsert_blocks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged block table with the hash each upsert replaced, if it differed.

    ``incoming`` carries an arrival number ``seq``; see :func:`latest_blocks`.
    """
    merged = latest_blocks(stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming))
    was = stored.select("chain_id", "number", F.col("hash").alias("was"))
    return merged.join(was, ["chain_id", "number"], "left").select(
        "chain_id", "number", "hash", "parent_hash", "block_ts",
        F.when(F.col("was") != F.col("hash"), F.col("was")).alias("previous_hash"))


# --- cursors and chain state -----------------------------------------------

def read_cursors(contracts: DataFrame, cursors: DataFrame) -> DataFrame:
    """Next block per contract, 0 where none is stored."""
    return (
        contracts.select("chain_id", F.col("address").alias("contract"))
        .join(cursors, ["chain_id", "contract"], "left")
        .select("chain_id", "contract", F.coalesce("next_block", F.lit(0)).alias("next_block"))
    )


def advance_cursors(cursors: DataFrame, progress: DataFrame) -> DataFrame:
    """Cursors moved to the furthest of stored and reported; never backwards."""
    return (
        cursors.unionByName(progress)
        .groupBy("chain_id", "contract").agg(F.max("next_block").alias("next_block"))
    )


def chain_state(blocks: DataFrame, finality_depth: int) -> DataFrame:
    """Head per chain, and the finalized block once the chain is deep enough."""
    return blocks.groupBy("chain_id").agg(F.max("number").alias("head")).withColumn(
        "finalized",
        F.when(F.col("head") >= finality_depth, F.col("head") - finality_depth))
