"""State views: leader, members and lifecycle as of a block.

Each view is an order-free aggregate keyed by position, in three steps.
``partial`` reduces events to one mergeable row per key, ``merge`` combines
such rows (it is associative, commutative and idempotent, so the same rows
serve batch replay, incremental upkeep and redelivery), ``finish`` turns them
into the answer. A busy contract reduces inside every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.functions import hexes
from logtide.session import per_chain, sized

CLUSTER = ["chain_id", "contract"]
MEMBER = ["chain_id", "contract", "member_id"]


@dataclass(frozen=True)
class StateView:
    """A view plug-in over DataFrames."""

    name: str
    kinds: tuple[str, ...]
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame, DataFrame | None], DataFrame]
    needs_blocks: bool = False
    #: How each column of a partial row combines, F.max or F.min; needed by :func:`as_of_many` alone.
    fields: tuple[tuple[str, Callable], ...] = ()

    def events(self, events: DataFrame, as_of: int | DataFrame | None = None,
               blocks: DataFrame | None = None) -> DataFrame:
        """Canonical events this view folds, cut at ``as_of``."""
        rows = up_to(canonical(events).where(F.col("kind").isin(*self.kinds)), as_of)
        return with_block_row(rows, blocks) if self.needs_blocks else rows

    def replay(self, events: DataFrame, as_of: int | DataFrame | None = None,
               blocks: DataFrame | None = None) -> DataFrame:
        return self.finish(self.partial(self.events(events, as_of, blocks)), blocks)

    def apply(self, state: DataFrame, batch: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """State rows after one more batch of events; redelivered events change nothing."""
        return self.merge(state.unionByName(self.partial(self.events(batch, None, blocks))))


def canonical(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("removed"))


def up_to(rows: DataFrame, as_of: int | DataFrame | None) -> DataFrame:
    """Rows at or below a block: one number, or (chain_id, as_of_block) per chain."""
    if as_of is None:
        return rows
    if isinstance(as_of, int):
        return rows.where(F.col("block_number") <= as_of)
    cut = per_chain(as_of.select("chain_id", "as_of_block"))
    return rows.join(cut, "chain_id").where(F.col("block_number") <= F.col("as_of_block")).drop("as_of_block")


def unknown_blocks(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chain_id, block_number) of events whose block is not known.

    Only distinct blocks meet the block table. The (normally empty) list is written first, so this runs a job.
    """
    on = ["chain_id", "block_number"]
    return sized(events.select(*on).distinct().join(
        blocks.select("chain_id", F.col("number").alias("block_number")), on, "left_anti"), "unknown-blocks")


def with_block_row(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Drop events whose block is unknown; they are not shuffled for it."""
    return events.join(unknown_blocks(events, blocks), ["chain_id", "block_number"], "left_anti")


def block_times(blocks: DataFrame, number_as: str, ts_as: str) -> DataFrame:
    return blocks.select("chain_id", F.col("number").alias(number_as), F.col("block_ts").alias(ts_as))


def _position() -> list[Column]:
    return [F.col("block_number"), F.col("log_index")]


# --- leader ----------------------------------------------------------------

UINT256_DIGITS = 78


def _epoch() -> Column:
    """Epoch of a claim as decimal text of fixed width, so that text order is number order."""
    return F.lpad("decoded.epoch", UINT256_DIGITS, "0")


def epoch_text(epoch: Column) -> Column:
    """An epoch of any width in plain decimal."""
    digits = F.ltrim(epoch, F.lit("0"))
    return F.when(digits == "", F.lit("0")).otherwise(digits)


def _epoch_number(epoch: Column) -> Column:
    """An epoch as a signed 64-bit value; one past it fails the read."""
    number = epoch.try_cast("bigint")
    return F.when(epoch.isNotNull() & number.isNull(),
                  F.raise_error(F.concat(F.lit("leader epoch past 64 bits: "), epoch_text(epoch))).cast("bigint")).otherwise(number)


def _best_claim() -> Column:
    epoch = _epoch()
    claim = F.struct(epoch.alias("epoch"), (-F.col("block_number")).alias("minus_block"),
                     (-F.col("log_index")).alias("minus_index"), F.col("decoded.memberId").alias("member_id"))
    return F.max(F.when(epoch.isNotNull() & (F.col("kind") == "LeaderClaimed"), claim)).alias("claim")


def _leader_partial(events: DataFrame) -> DataFrame:
    return events.groupBy(*CLUSTER).agg(_best_claim())


def _leader_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CLUSTER).agg(F.max("claim").alias("claim"))


def _leader_finish(rows: DataFrame, _blocks: DataFrame | None = None) -> DataFrame:
    return rows.where(F.col("claim").isNotNull()).select(
        *CLUSTER, F.col("claim.member_id").alias("member_id"), _epoch_number(F.col("claim.epoch")).alias("epoch"),
        (-F.col("claim.minus_block")).alias("claimed_block"))


def wide_leaders(rows: DataFrame) -> DataFrame:
    """Leaders from merged rows with the epoch as decimal text, for epochs of any width."""
    return rows.where(F.col("claim").isNotNull()).select(
        *CLUSTER, F.col("claim.member_id").alias("member_id"), epoch_text(F.col("claim.epoch")).alias("epoch"),
        (-F.col("claim.minus_block")).alias("claimed_block"))


LEADER = StateView("leader", ("LeaderClaimed",), tuple(CLUSTER),
                   _leader_partial, _leader_merge, _leader_finish, fields=(("claim", F.max),))


def leader_for(clusters: DataFrame, leaders: DataFrame, as_of_block: int) -> DataFrame:
    """An answer for every requested cluster; without a claim, the zero member at epoch 0."""
    return clusters.select(*CLUSTER).join(leaders, CLUSTER, "left").select(
        *CLUSTER, F.coalesce("member_id", F.lit(hexes.ZERO32)).alias("member_id"),
        F.coalesce("epoch", F.lit(0)).alias("epoch"),
        F.lit(as_of_block).cast("long").alias("as_of_block"), "claimed_block")


# --- members ---------------------------------------------------------------

def _last_fields() -> list[Column]:
    """What a member's registrations, endpoints and retirements come to; other events count for nothing."""
    kind = F.col("kind")
    position = _position()
    registered = F.struct(*position, F.col("decoded.instanceId").alias("instance_id"),
                          F.col("decoded.passthrough").alias("passthrough"),
                          F.col("decoded.dnsLabel").alias("dns_label"))
    endpoint = F.struct(*position, hexes.text_or_hex(F.col("decoded.publicEndpoint")).alias("text"))
    at = F.struct(*position)
    return [F.max(F.when(kind == "MemberRegistered", registered)).alias("registered"),
            F.max(F.when(kind == "PublicEndpointUpdated", endpoint)).alias("endpoint"),
            F.max(F.when(kind == "MemberRetired", at)).alias("retired"),
            F.min(F.when(kind.isin("MemberRegistered", "PublicEndpointUpdated"), at)).alias("seen")]


def _members_partial(events: DataFrame) -> DataFrame:
    return events.withColumn("member_id", F.col("decoded.memberId")).groupBy(*MEMBER).agg(*_last_fields())


def _members_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MEMBER).agg(
        F.max("registered").alias("registered"), F.max("endpoint").alias("endpoint"),
        F.max("retired").alias("retired"), F.min("seen").alias("seen"))


def _members_finish(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Last value per field. A retirement counts only after the member was first seen."""
    known = rows.where(F.col("seen").isNotNull()).select(
        "*", F.col("registered.block_number").alias("registered_block"),
        F.when(F.col("retired") > F.col("seen"), F.col("retired.block_number")).alias("retired_block"))
    return (
        known.join(block_times(blocks, "registered_block", "registered_at"),
                   ["chain_id", "registered_block"], "left")
        .join(block_times(blocks, "retired_block", "retired_at"), ["chain_id", "retired_block"], "left")
        .select(*MEMBER, "registered.instance_id", "registered.passthrough", "registered.dns_label",
                F.col("endpoint.text").alias("public_endpoint"), "registered_at", "retired_at")
    )


MEMBERS = StateView("members", ("MemberRegistered", "PublicEndpointUpdated", "MemberRetired"),
                    tuple(MEMBER), _members_partial, _members_merge, _members_finish, needs_blocks=True,
                    fields=(("registered", F.max), ("endpoint", F.max), ("retired", F.max), ("seen", F.min)))


def active(members: DataFrame, include_retired: bool = False) -> DataFrame:
    return members if include_retired else members.where(F.col("retired_at").isNull())


def in_member_order(members: DataFrame) -> DataFrame:
    return members.orderBy(*MEMBER)


# --- lifecycle -------------------------------------------------------------

def _lifecycle_partial(events: DataFrame) -> DataFrame:
    return events.groupBy(*CLUSTER).agg(F.min("block_number").alias("destroyed_block"))


def _lifecycle_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CLUSTER).agg(F.min("destroyed_block").alias("destroyed_block"))


def _lifecycle_finish(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return (
        rows.select(*CLUSTER, "destroyed_block")
        .join(block_times(blocks, "destroyed_block", "destroyed_at"), ["chain_id", "destroyed_block"])
        .select(*CLUSTER, "destroyed_at")
    )


LIFECYCLE = StateView("lifecycle", ("ClusterDestroyed",), tuple(CLUSTER),
                      _lifecycle_partial, _lifecycle_merge, _lifecycle_finish, needs_blocks=True,
                      fields=(("destroyed_block", F.min),))

VIEWS = {v.name: v for v in (LEADER, MEMBERS, LIFECYCLE)}


def lifecycle_for(clusters: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return clusters.select(*CLUSTER).join(lifecycle, CLUSTER, "left")


def overview(clusters: DataFrame, events: DataFrame, blocks: DataFrame, as_of_block: int) -> DataFrame:
    """Leader, member counts and lifecycle of every requested cluster.

    One fold serves all three: rows are keyed by (cluster, member), claims and ends under a NULL member. Whole events are
    read once; before that, their block numbers, to find blocks that are not known.
    """
    rows = up_to(canonical(events).where(F.col("kind").isin(*LEADER.kinds, *MEMBERS.kinds, *LIFECYCLE.kinds)), as_of_block)
    claim = F.col("kind").isin(*LEADER.kinds)
    unknown = unknown_blocks(rows.where(~claim), blocks).withColumn("_unknown", F.lit(True))
    known = rows.join(unknown, ["chain_id", "block_number"], "left").where(claim | F.col("_unknown").isNull())
    member = F.when(F.col("kind").isin(*MEMBERS.kinds), F.col("decoded.memberId"))
    folded = sized(known.withColumn("member_id", member).groupBy(*MEMBER).agg(
        _best_claim(), F.min(F.when(F.col("kind").isin(*LIFECYCLE.kinds), F.col("block_number"))).alias("destroyed_block"),
        *_last_fields()), "overview")
    counts = _members_finish(folded.where(F.col("member_id").isNotNull()), blocks).groupBy(*CLUSTER).agg(
        F.count(F.lit(1)).alias("members_count"),
        F.count_if(F.col("retired_at").isNull()).alias("active_count"))
    whole = folded.where(F.col("member_id").isNull())
    leaders = leader_for(clusters, _leader_finish(whole), as_of_block)
    zero = F.lit(0).cast("long")
    return (
        leaders.join(counts, CLUSTER, "left")
        .join(_lifecycle_finish(whole.where(F.col("destroyed_block").isNotNull()), blocks), CLUSTER, "left")
        .withColumns({"members_count": F.coalesce("members_count", zero),
                      "active_count": F.coalesce("active_count", zero)})
    )


# --- many blocks at once ------------------------------------------------------

def as_of_many(view: StateView, events: DataFrame, requests: DataFrame, blocks: DataFrame | None = None,
               bucket_blocks: int = 10_000) -> DataFrame:
    """A view as of many blocks in one job: the answer's columns with request_id and as_of_block.

    ``requests`` is (request_id, chain_id, contract, as_of_block). A key's history is laid down as states valid from
    the end of one block bucket to that of the next in which it has events. A request joins the one state that is
    valid before its bucket begins, and from its own bucket the events up to its block. So a request
    reads a bucket instead of a chain's past, and no window is longer than the number of a key's buckets.
    """
    asked = sized(requests.select("request_id", "chain_id", "contract", "as_of_block",
                                  F.floor(F.col("as_of_block") / bucket_blocks).alias("bucket")), "requests")
    wanted = asked.groupBy(*CLUSTER).agg(F.max("as_of_block").alias("last"))
    rows = view.events(events, None, blocks).join(sized(wanted, "wanted"), CLUSTER).where(F.col("block_number") <= F.col("last")).drop("last")
    rows = rows.withColumn("bucket", F.floor(F.col("block_number") / bucket_blocks))
    keys = list(view.keys)
    # the bucket and the request travel inside a key that every fold groups by
    tagged = view.partial(rows.withColumn("chain_id", F.struct("chain_id", "bucket")).drop("bucket"))
    parts = tagged.withColumns({"bucket": F.col("chain_id.bucket"), "chain_id": F.col("chain_id.chain_id")})
    so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    states = parts.withColumns({n: how(n).over(so_far) for n, how in view.fields} | {
        "until": F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))}).alias("s")
    r = asked.alias("r")
    same = (F.col("r.chain_id") == F.col("s.chain_id")) & (F.col("r.contract") == F.col("s.contract"))
    valid = (F.col("s.bucket") < F.col("r.bucket")) & (F.col("s.until").isNull() | (F.col("s.until") >= F.col("r.bucket")))
    request = F.struct(F.col("r.contract").alias("contract"), "r.request_id", "r.as_of_block")
    names = [n for n, _ in view.fields]
    before = r.join(states, same & valid).select(
        *[(request.alias("contract") if k == "contract" else F.col(f"s.{k}")) for k in keys], *[F.col(f"s.{n}") for n in names])
    e = rows.alias("s")
    inside = r.join(e, same & (F.col("s.bucket") == F.col("r.bucket")) & (F.col("s.block_number") <= F.col("r.as_of_block"))).select(
        request.alias("contract"), *[F.col(f"s.{c}") for c in rows.columns if c not in ("contract", "bucket")])
    answer = view.finish(view.merge(before.unionByName(view.partial(inside).select(before.columns))), blocks)
    return answer.withColumns({"request_id": F.col("contract.request_id"), "as_of_block": F.col("contract.as_of_block"),
                               "contract": F.col("contract.contract")})


# --- anomaly reports -------------------------------------------------------

def leader_conflicts(events: DataFrame, as_of: int | DataFrame | None = None) -> DataFrame:
    """Epochs claimed by more than one member.

    Smallest against largest member id tells whether they differ, which a
    partial aggregate can carry; a distinct count could not combine map-side.
    """
    member = F.col("decoded.memberId")
    claims = LEADER.events(events, as_of).withColumn("epoch", _epoch())
    return (
        claims.groupBy(*CLUSTER, "epoch")
        .agg(F.min(member).alias("low"), F.max(member).alias("high"), F.count(F.lit(1)).alias("claims"))
        .where(F.col("low") != F.col("high")).drop("low", "high")
        .withColumn("epoch", _epoch_number(F.col("epoch")))
    )


def member_anomalies(events: DataFrame, blocks: DataFrame,
                     as_of: int | DataFrame | None = None) -> DataFrame:
    """Members whose endpoint came before registration, or that retired while unknown."""
    rows = MEMBERS.events(events, as_of, blocks)
    at = F.struct(*_position())
    first = lambda kind: F.min(F.when(F.col("kind") == kind, at))
    grouped = rows.withColumn("member_id", F.col("decoded.memberId")).groupBy(*MEMBER).agg(
        first("MemberRegistered").alias("registered"), first("PublicEndpointUpdated").alias("endpoint"),
        first("MemberRetired").alias("retired"))
    seen = F.least("registered", "endpoint")
    early = F.col("endpoint").isNotNull() & (
        F.col("registered").isNull() | (F.col("endpoint") < F.col("registered")))
    unknown = F.col("retired").isNotNull() & (seen.isNull() | (F.col("retired") < seen))
    return grouped.select(
        *MEMBER, F.coalesce(early, F.lit(False)).alias("endpoint_before_register"),
        F.coalesce(unknown, F.lit(False)).alias("retire_of_unknown"),
    ).where("endpoint_before_register or retire_of_unknown")
