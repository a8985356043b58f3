"""Control instructions, acknowledgements and holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions import hexes, numbers
from logtide.operators.ingest import new_rows, first_write
from logtide.operators.views import canonical, up_to

CLUSTER = ["chain_id", "cluster"]
CONFIRMATIONS = 12

# Every reason a hole row may carry.
HOLE_REASONS = ("buffer_expired", "buffer_age", "buffer_full", "manual")

INSTRUCTION_KEY = ["chain_id", "cluster", "nonce"]
ACK_KEY = ["chain_id", "cluster", "job_id", "seq"]
HOLE_KEY = ["chain_id", "cluster", "missing_nonce"]
ARRIVAL = ["row_id"]


def _provenance() -> list[Column]:
    return [F.col(c) for c in ("block_number", "log_index", "tx_hash", "removed")]


def instructions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed instruction rows, and the events whose values do not fit storage."""
    d = F.col("decoded")
    rows = events.where(F.col("kind") == "ControlInstructionBroadcast").withColumns({
        "nonce": numbers.narrow_int64(d["nonce"]), "expiry": numbers.narrow_int64(d["expiry"])})
    fits = F.col("nonce").isNotNull() & F.col("expiry").isNotNull()
    typed = rows.where(fits).select(
        F.col("event_id").alias("row_id"), "chain_id", F.col("contract").alias("cluster"),
        d["instructionId"].alias("instruction_id"), "nonce", d["targetMembers"].alias("target_members"),
        "expiry", d["salt"].alias("salt"), d["ciphertext"].alias("ciphertext"),
        d["ciphertextHash"].alias("ciphertext_hash"), *_provenance())
    return typed, rows.where(~fits)


def acks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed ack rows and rejects. A zero log pointer and an empty summary mean "not set"."""
    d = F.col("decoded")
    rows = events.where(F.col("kind") == "ControlAck").withColumn("seq", numbers.narrow_int64(d["seq"]))
    fits = F.col("seq").isNotNull()
    typed = rows.where(fits).select(
        F.col("event_id").alias("row_id"), "chain_id", F.col("contract").alias("cluster"),
        d["instructionId"].alias("instruction_id"), d["jobId"].alias("job_id"),
        d["memberId"].alias("member_id"), d["status"].alias("status"), "seq",
        F.nullif(d["logPointer"], F.lit(hexes.ZERO32)).alias("log_pointer"),
        F.nullif(d["summary"], F.lit(hexes.EMPTY)).alias("summary"), *_provenance())
    return typed, rows.where(~fits)


# --- sinks -----------------------------------------------------------------

def add_instructions(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first live row per (cluster, nonce)."""
    return _add(batch, stored, INSTRUCTION_KEY)


def add_acks(batch: DataFrame, stored: DataFrame | None = None, per_member: bool = False) -> DataFrame:
    """Rows to append: the first live row per (cluster, job, seq), or also per member."""
    return _add(batch, stored, ACK_KEY + (["member_id"] if per_member else []))


def _add(batch: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    if stored is None:
        return first_write(canonical(batch), keys, ARRIVAL)
    return new_rows(canonical(batch), canonical(stored), keys, ARRIVAL)


# --- reads -----------------------------------------------------------------

def is_target(targets: Column, member: Column) -> Column:
    """An empty target list addresses everyone."""
    return (F.size(targets) == 0) | F.array_contains(targets, member)


def finality_bound(head: Column, confirmations: int = CONFIRMATIONS) -> Column:
    """Highest block deep enough under the head, never below 0."""
    return F.greatest(head - confirmations, F.lit(0))


def highest_final_nonce(rows: DataFrame, clusters: DataFrame, max_block: int) -> DataFrame:
    """Highest live nonce at or below a block per requested cluster; NULL if none."""
    best = up_to(canonical(rows), max_block).groupBy(*CLUSTER).agg(F.max("nonce").alias("highest_nonce"))
    return clusters.select(*CLUSTER).join(best, CLUSTER, "left")


def start_cursors(rows: DataFrame, clusters: DataFrame, max_block: int) -> DataFrame:
    """Cold-start nonce of the orderer per cluster: highest final nonce + 1, else 0."""
    best = highest_final_nonce(rows, clusters, max_block)
    return best.select(*CLUSTER, F.coalesce(F.col("highest_nonce") + 1, F.lit(0)).alias("initial"))


def final_since(rows: DataFrame, since_nonce: int, max_block: int) -> DataFrame:
    """Live instructions from a nonce on, at or below a block, by nonce."""
    return up_to(canonical(rows), max_block).where(F.col("nonce") >= since_nonce).orderBy(
        *CLUSTER, "nonce")


# --- holes -----------------------------------------------------------------

def record_holes(stored: DataFrame, observed: DataFrame, now: int | Column) -> DataFrame:
    """Hole table after observations (chain_id, cluster, missing_nonce, highest_buffered, reason).

    A known hole takes the new bound and reason and opens again, keeping its
    first ``observed_at``. One observation per key is expected.
    """
    stamp = F.lit(now).cast("long") if isinstance(now, int) else now
    fresh = observed.select(*HOLE_KEY, F.col("highest_buffered").alias("_bound"),
                            F.col("reason").alias("_reason"))
    hit = F.col("_reason").isNotNull()
    return stored.join(fresh, HOLE_KEY, "full_outer").select(
        *HOLE_KEY, F.coalesce("_bound", "highest_buffered").alias("highest_buffered"),
        F.coalesce("_reason", "reason").alias("reason"),
        F.coalesce("observed_at", stamp).alias("observed_at"),
        F.when(~hit, F.col("resolved_at")).alias("resolved_at"))


def resolve_holes(stored: DataFrame, arrived: DataFrame, now: int | Column) -> DataFrame:
    """Hole table after the given (chain_id, cluster, nonce) arrived; ``changed`` marks closures."""
    stamp = F.lit(now).cast("long") if isinstance(now, int) else now
    keys = arrived.select(*CLUSTER, F.col("nonce").alias("missing_nonce")).distinct().withColumn(
        "_arrived", F.lit(True))
    closes = F.coalesce("_arrived", F.lit(False)) & F.col("resolved_at").isNull()
    return (
        stored.join(keys, HOLE_KEY, "left").withColumn("changed", closes)
        .withColumn("resolved_at", F.when(F.col("changed"), stamp).otherwise(F.col("resolved_at")))
        .drop("_arrived")
    )


def open_holes(holes: DataFrame) -> DataFrame:
    return holes.where(F.col("resolved_at").isNull()).orderBy(*HOLE_KEY)


# --- delivery --------------------------------------------------------------

def member_backlog(rows: DataFrame, member: bytes, since_nonce: int, max_block: int,
                   cluster: bytes | None = None) -> DataFrame:
    """What one member reads on connect: final instructions addressed to it."""
    if cluster is not None:
        rows = rows.where(F.col("cluster") == F.lit(cluster))
    return final_since(rows.where(is_target(F.col("target_members"), F.lit(member))),
                       since_nonce, max_block)


def by_audience(rows: DataFrame) -> DataFrame:
    """Instructions keyed by reader: one row per target, one NULL-member row for everyone.

    A broadcast stays a single row, so the feed grows with the instructions
    and not with instructions times members.
    """
    audience = F.when(F.size("target_members") == 0, F.array(F.lit(None).cast("binary"))).otherwise(
        F.array_distinct("target_members"))
    return rows.withColumn("member_id", F.explode(audience))


def addressed_to(feed: DataFrame, member: Column | bytes) -> DataFrame:
    """Rows of a :func:`by_audience` feed one member reads."""
    who = F.lit(member) if isinstance(member, bytes) else member
    return feed.where(F.col("member_id").isNull() | (F.col("member_id") == who))


def connect_feed(holes: DataFrame, backlog: DataFrame) -> DataFrame:
    """Frames of a connecting reader: open holes first, then instructions by nonce."""
    hole_frames = open_holes(holes).select(
        *CLUSTER, F.lit(0).alias("part"), F.lit("hole").alias("frame"), F.col("missing_nonce").alias("nonce"),
        F.to_json(F.struct("missing_nonce", "highest_buffered", "reason", "observed_at")).alias("body"))
    instruction_frames = backlog.select(
        *CLUSTER, F.lit(1).alias("part"), F.lit("instruction").alias("frame"), "nonce",
        F.to_json(F.struct(
            hexes.hex0x(F.col("instruction_id")).alias("instruction_id"), "nonce",
            F.transform("target_members", hexes.hex0x).alias("target_members"), "expiry",
            hexes.hex0x(F.col("salt")).alias("salt"), hexes.hex0x(F.col("ciphertext")).alias("ciphertext"),
            hexes.hex0x(F.col("ciphertext_hash")).alias("ciphertext_hash"), "block_number", "log_index",
            hexes.hex0x(F.col("tx_hash")).alias("tx_hash"))).alias("body"))
    return hole_frames.unionByName(instruction_frames).orderBy(*CLUSTER, "part", "nonce")
