"""Strict per-cluster nonce order over instructions, as a batch.

The contiguous run from a cluster's cursor ends at its first missing nonce.
That nonce is found without ordering a cluster anywhere: each nonce n marks
slot n as present and slot n+1 as wanted, slots combine by (cluster, nonce),
and the lowest slot wanted but absent is where delivery stops. Work spreads
over (cluster, nonce), so one very busy cluster uses every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.operators.control import CLUSTER, CONFIRMATIONS
from logtide.session import per_chain, sized

MAX_BUFFER = 100
MAX_BUFFER_AGE = 3600

DISPATCHED = "Dispatched"
AWAITING = "AwaitingPredecessor"
NOT_FINAL = "NotFinal"
DROPPED = "Dropped"


def has_finality(block: Column, head: Column, confirmations: int = CONFIRMATIONS) -> Column:
    """Deep enough under the head; head 0 means the head is unknown and the gate open."""
    return (head == 0) | (F.greatest(head - block, F.lit(0)) >= confirmations)


def _prepared(rows: DataFrame, heads: DataFrame, initial: DataFrame | None,
              confirmations: int, headless_final: bool = True) -> DataFrame:
    rows = rows.join(per_chain(heads.select("chain_id", "head")), "chain_id", "left")
    if initial is None:
        rows = rows.withColumn("initial", F.lit(0).cast("long"))
    else:
        rows = rows.join(initial.select(*CLUSTER, "initial"), CLUSTER, "left")
    head = F.coalesce("head", F.lit(0))
    return rows.withColumns({
        "initial": F.coalesce("initial", F.lit(0)),
        "final": has_finality(F.col("block_number"), head, confirmations)
        & (F.lit(headless_final) | F.col("head").isNotNull()),
    }).drop("head")


def run_ends(prepared: DataFrame) -> DataFrame:
    """Per cluster: the cursor after delivery and the nonces left waiting.

    Input: distinct (cluster, nonce) rows with ``initial`` and ``final``.
    """
    slots = prepared.where(F.col("final") & (F.col("nonce") >= F.col("initial"))).select(
        *CLUSTER, "initial", F.explode(F.array(
            F.struct(F.col("nonce").alias("slot"), F.lit(1).alias("have"), F.lit(0).alias("want")),
            F.struct((F.col("nonce") + 1).alias("slot"), F.lit(0).alias("have"), F.lit(1).alias("want")),
        )).alias("mark")).select(*CLUSTER, "initial", "mark.*")
    combined = slots.groupBy(*CLUSTER, "slot").agg(
        F.max("initial").alias("initial"), F.max("have").alias("have"), F.max("want").alias("want"))
    have = F.col("have") == 1
    per_cluster = combined.groupBy(*CLUSTER).agg(
        F.max("initial").alias("initial"), F.sum("have").alias("held"),
        F.min(F.when(have, F.col("slot"))).alias("lowest"),
        F.max(F.when(have, F.col("slot"))).alias("highest"),
        F.min(F.when(~have, F.col("slot"))).alias("first_gap"))
    next_expected = F.when(F.col("lowest") > F.col("initial"), F.col("initial")).otherwise(F.col("first_gap"))
    return per_cluster.select(
        *CLUSTER, "initial", next_expected.alias("next_expected"),
        F.when(F.col("highest") >= next_expected, F.col("highest")).alias("highest_buffered"),
        (F.col("held") - (next_expected - F.col("initial"))).alias("buffered"))


def order(rows: DataFrame, heads: DataFrame, initial: DataFrame | None = None,
          confirmations: int = CONFIRMATIONS, headless_final: bool = True) -> DataFrame:
    """Instructions with ``outcome`` and their cluster's ``next_expected``.

    A chain without a head leaves the gate open, as a batch over finished data
    wants it; a live job closes it with ``headless_final=False``.

    ``rows`` holds one row per (cluster, nonce), as the sink keeps them.
    ``heads`` is (chain_id, head); ``initial`` is (chain_id, cluster, initial).
    The run ends (one row per cluster) are written first, so this runs a job;
    the labelling pass then need not shuffle the instructions by cluster.
    """
    prepared = _prepared(rows, heads, initial, confirmations, headless_final)
    ends = sized(run_ends(prepared).select(*CLUSTER, F.col("next_expected").alias("_end")), "run-ends")
    labelled = prepared.join(ends, CLUSTER, "left").withColumn(
        "next_expected", F.coalesce("_end", "initial"))
    nonce = F.col("nonce")
    outcome = (
        F.when(~F.col("final"), F.lit(NOT_FINAL)).when(nonce < F.col("initial"), F.lit(DROPPED))
        .when(nonce < F.col("next_expected"), F.lit(DISPATCHED)).otherwise(F.lit(AWAITING))
    )
    return labelled.withColumn("outcome", outcome).drop("_end", "initial", "final")


def cursors(rows: DataFrame, heads: DataFrame, initial: DataFrame | None = None,
            confirmations: int = CONFIRMATIONS) -> DataFrame:
    """next_expected, highest_buffered and buffer size per cluster with final rows."""
    return run_ends(_prepared(rows, heads, initial, confirmations))


def find_holes(ordered: DataFrame, now: int, max_buffer: int = MAX_BUFFER,
               max_age: int = MAX_BUFFER_AGE) -> DataFrame:
    """Stalled clusters of an :func:`order` result, with the reason.

    The lowest waiting row decides on expiry, then on age (needs a
    ``buffered_at`` column in seconds), then the number waiting.
    """
    waiting = ordered.where(F.col("outcome") == AWAITING)
    if "buffered_at" not in ordered.columns:
        waiting = waiting.withColumn("buffered_at", F.lit(None).cast("long"))
    grouped = waiting.groupBy(*CLUSTER).agg(
        F.min(F.struct("nonce", "expiry", "buffered_at")).alias("low"),
        F.max("nonce").alias("highest_buffered"), F.count(F.lit(1)).alias("buffered"),
        F.max("next_expected").alias("missing_nonce"))
    age = F.greatest(F.lit(now) - F.col("low.buffered_at"), F.lit(0))
    reason = (
        F.when(F.col("low.expiry") <= now, F.lit("buffer_expired"))
        .when(F.col("low.buffered_at").isNotNull() & (age >= max_age), F.lit("buffer_age"))
        .when(F.col("buffered") > max_buffer, F.lit("buffer_full"))
    )
    return (
        grouped.withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select(*CLUSTER, "missing_nonce", "highest_buffered", "reason")
    )


def closed_holes(holes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Open holes whose missing nonce has now been dispatched."""
    arrived = ordered.where(F.col("outcome") == DISPATCHED).select(
        *CLUSTER, F.col("nonce").alias("missing_nonce"))
    return holes.where(F.col("resolved_at").isNull()).join(
        arrived, CLUSTER + ["missing_nonce"], "left_semi")


def evict_above(rows: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Waiting rows that survive a reorg; rows above the chain's ancestor go.

    ``ancestors`` is (chain_id, ancestor), one row per reorganised chain.
    """
    return (
        rows.join(per_chain(ancestors.select("chain_id", "ancestor")), "chain_id", "left")
        .where(F.col("ancestor").isNull() | (F.col("block_number") <= F.col("ancestor")))
        .drop("ancestor")
    )
