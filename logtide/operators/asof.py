"""Resolution of read requests to a block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

SAFETIES = ("head", "finalized")


def check_request(safety: str | None, as_of_block: int | None) -> str:
    """Validate read options; returns the effective safety."""
    if safety is not None and as_of_block is not None:
        raise ValueError("give a safety or a block, not both")
    if safety is not None and safety not in SAFETIES:
        raise ValueError(f"no such safety: {safety!r} (one of {', '.join(SAFETIES)})")
    return safety or "head"


def check_requests(requests: DataFrame) -> DataFrame:
    """A request table with ``status``: ok, both_given or unknown_safety; the batch form of :func:`check_request`."""
    given = F.col("safety").isNotNull()
    return requests.withColumn("status", F.when(given & F.col("as_of_block").isNotNull(), F.lit("both_given"))
                               .when(given & ~F.col("safety").isin(*SAFETIES), F.lit("unknown_safety")).otherwise(F.lit("ok")))


def resolve(requests: DataFrame, state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block, hash and timestamp each request reads at.

    ``requests`` is (request_id, chain_id, safety, as_of_block). ``status`` is that of
    :func:`check_requests`, or past_head or no_block_row; explicit blocks report safety ``head``.
    """
    requests = check_requests(requests)
    head, finalized = (F.coalesce(c, F.lit(0)) for c in ("head", "finalized"))
    explicit = F.col("as_of_block").isNotNull()
    target = F.when(explicit, F.col("as_of_block")).when(
        F.col("safety") == "finalized", finalized).otherwise(head)
    placed = requests.join(state.select("chain_id", "head", "finalized"), "chain_id", "left").select(
        "request_id", "chain_id", "status", F.when(F.col("status") == "ok", target.cast("long")).alias("block_number"),
        finalized.alias("finalized_block"),
        F.when(explicit, F.lit("head")).otherwise(F.coalesce("safety", F.lit("head"))).alias("safety"),
        (explicit & (F.col("as_of_block") > head)).alias("past_head"))
    rows = blocks.select("chain_id", F.col("number").alias("block_number"),
                         F.col("hash").alias("block_hash"), F.col("block_ts").alias("block_timestamp"))
    status = (F.when(F.col("status") != "ok", F.col("status")).when(F.col("past_head"), F.lit("past_head"))
              .when(F.col("block_hash").isNull(), F.lit("no_block_row")).otherwise(F.lit("ok")))
    resolved = placed.join(rows, ["chain_id", "block_number"], "left").withColumn("status", status)
    served = F.col("status") == "ok"
    return resolved.select(
        "request_id", "chain_id", "block_number", F.when(served, F.col("block_hash")).alias("block_hash"),
        F.when(served, F.col("block_timestamp")).alias("block_timestamp"),
        "finalized_block", "safety", "status")


@dataclass(frozen=True)
class AsOf:
    """One resolved read point."""

    chain_id: int
    block_number: int
    block_hash: bytes
    block_timestamp: int
    finalized_block: int
    safety: str


class NotFound(LookupError):
    """The requested block, member or event does not exist."""


def resolve_one(state: DataFrame, blocks: DataFrame, chain_id: int, safety: str | None = None,
                as_of_block: int | None = None) -> AsOf:
    """Strict form for one chain; raises :class:`NotFound`. Reads a single row to the driver."""
    effective = check_request(safety, as_of_block)
    request = state.sparkSession.createDataFrame(
        [(0, chain_id, effective if as_of_block is None else None, as_of_block)],
        "request_id int, chain_id int, safety string, as_of_block long")
    row = resolve(request, state.where(F.col("chain_id") == chain_id),
                  blocks.where(F.col("chain_id") == chain_id)).first()
    if row["status"] != "ok":
        raise NotFound(f"chain {chain_id} block {row['block_number']}: {row['status']}")
    return AsOf(chain_id, row["block_number"], bytes(row["block_hash"]), row["block_timestamp"],
                row["finalized_block"], row["safety"])
