"""Change envelopes and subscriber filters, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from logtide.functions.hexes import hex0x
from logtide.operators.pages import of_cluster, of_kinds
from logtide.operators.views import canonical


def _envelopes(rows: DataFrame, body: list) -> DataFrame:
    return rows.select("event_id", "chain_id", F.to_json(F.struct(*body)).alias("payload"))


def change_feed(events: DataFrame) -> DataFrame:
    """One small envelope per applied event; undecoded events have kind ``unknown``."""
    return _envelopes(events, [
        hex0x(F.col("contract")).alias("cluster"), F.coalesce("kind", F.lit("unknown")).alias("kind"),
        "event_id", "block_number", "log_index"])


def control_feed(rows: DataFrame, kind: str) -> DataFrame:
    """Envelopes of instruction or ack rows, with the row id readers page by."""
    with_id = rows.withColumn("event_id", F.col("row_id"))
    return _envelopes(with_id, [
        hex0x(F.col("cluster")).alias("cluster"), F.lit(kind).alias("kind"), "row_id", "event_id",
        "block_number", "log_index"])


def subscription(events: DataFrame, since: int | None = None, contract: bytes | None = None,
                 kinds: Sequence[str] = (), chain_id: int | None = None) -> DataFrame:
    """Live rows a subscriber reads: one filter for backlog and tail."""
    rows = of_kinds(canonical(of_cluster(events, contract, chain_id)), kinds)
    return rows.where(F.col("event_id") > (since or 0))

