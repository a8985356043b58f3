"""Event pages, single events and proof events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.operators.decode import payload_json
from logtide.operators.views import CLUSTER, canonical, up_to

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000

# The event kinds behind each view's proof.
PROOF_KINDS = {
    "leader": ["LeaderClaimed", "LeaderRevoked"],
    "members": ["MemberRegistered", "MemberRetired", "InstanceIdUpdated", "PublicEndpointUpdated"],
    "lifecycle": ["ClusterDestroyed"],
}


def parse_kinds(csv: str | None) -> list[str]:
    """Comma-separated kinds; an empty list means all kinds."""
    return [part.strip() for part in (csv or "").split(",") if part.strip()]


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def of_kinds(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds)) if kinds else events


def of_cluster(events: DataFrame, contract: bytes | None, chain_id: int | None = None) -> DataFrame:
    if contract is not None:
        events = events.where(F.col("contract") == F.lit(contract))
    return events if chain_id is None else events.where(F.col("chain_id") == chain_id)


PAGE_SALTS = 32


def _listed(events: DataFrame, since: int | None, kinds: Sequence[str],
            as_of: int | DataFrame | None) -> DataFrame:
    return of_kinds(up_to(canonical(events), as_of), kinds).where(F.col("event_id") > (since or 0))


def event_page(events: DataFrame, contract: bytes | None = None, chain_id: int | None = None,
               since: int | None = None, kinds: Sequence[str] = (), limit: int | None = None,
               as_of: int | DataFrame | None = None) -> DataFrame:
    """The next page by arrival id: a top-k, never a full sort."""
    rows = _listed(of_cluster(events, contract, chain_id), since, kinds, as_of)
    return rows.orderBy("event_id").limit(clamp_limit(limit))


def next_since(page: DataFrame) -> DataFrame:
    """Id to continue from; NULL after an empty page."""
    return page.agg(F.max("event_id").alias("next_since"))


def event_pages(events: DataFrame, since: int | None = None, kinds: Sequence[str] = (),
                limit: int | None = None, as_of: int | DataFrame | None = None) -> DataFrame:
    """The next page of every cluster in one job.

    A ``row_number`` bounded by a constant: Spark trims every task to the page
    size per cluster before it shuffles. It is taken per salt first, so a hot
    cluster's trimmed rows from all tasks meet in ``PAGE_SALTS`` places, not one.
    ``next_since`` is where the cluster's next page goes on.
    """
    size = clamp_limit(limit)
    salted = _listed(events, since, kinds, as_of).withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(PAGE_SALTS)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*CLUSTER, "_salt").orderBy("event_id"))).where(
        F.col("_rank") <= size).drop("_rank", "_salt")
    in_order = Window.partitionBy(*CLUSTER).orderBy("event_id")
    page = first.withColumn("page_rank", F.row_number().over(in_order)).where(F.col("page_rank") <= size)
    return page.withColumn("next_since", F.max("event_id").over(Window.partitionBy(*CLUSTER)))


def event_by_id(events: DataFrame, event_id: int | Column, chain_id: int | None = None) -> DataFrame:
    """One event; rolled-back rows resolve too, with their flag."""
    rows = events.where(F.col("event_id") == event_id)
    return rows if chain_id is None else rows.where(F.col("chain_id") == chain_id)


def proof_events(events: DataFrame, view: str, as_of: int | DataFrame | None = None,
                 contract: bytes | None = None, chain_id: int | None = None) -> DataFrame:
    """Raw rows a consumer needs to rebuild one view, in canonical order."""
    rows = up_to(canonical(of_cluster(events, contract, chain_id)), as_of)
    return of_kinds(rows, PROOF_KINDS[view]).select(
        "chain_id", "contract", "block_number", "log_index", "tx_hash", "topic0", "topics_rest",
        "data", "kind", payload_json(F.col("kind"), F.col("decoded")).alias("decoded"),
    ).orderBy("chain_id", "contract", "block_number", "log_index")
