"""The read API: every question a consumer asks, resolved at a block.

A :class:`ChainReader` covers one chain. Each read resolves its options to a
block first (one row to the driver), so the block bound and the contract reach
the scan as plain filters. Results are DataFrames; rows that do not exist raise
:class:`NotFound` only where the question is about one thing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from logtide.operators import asof, audit, control, health, orderer, pages, registry, views
from logtide.operators.asof import AsOf, NotFound
from logtide.operators.render import as_hex


def parse_identifier(text: str, size: int) -> bytes:
    """A request's hex address or member id; a wrong length or digit is an error."""
    raw = bytes.fromhex(text[2:] if text.startswith("0x") else text)
    if len(raw) != size:
        raise ValueError(f"expected {size} bytes, got {len(raw)}")
    return raw


@dataclass(frozen=True)
class ChainReader:
    """Reads over one chain's tables."""

    chain_id: int
    events: DataFrame
    blocks: DataFrame
    state: DataFrame
    watched: DataFrame
    instructions: DataFrame | None = None
    holes: DataFrame | None = None

    def _mine(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("chain_id") == self.chain_id)

    @cached_property
    def _spark(self):
        return self.events.sparkSession

    def at(self, safety: str | None = None, as_of_block: int | None = None) -> AsOf:
        return asof.resolve_one(self.state, self.blocks, self.chain_id, safety, as_of_block)

    def _cluster(self, cluster: str) -> tuple[bytes, DataFrame, DataFrame]:
        address = parse_identifier(cluster, 20)
        one = self._spark.createDataFrame([(self.chain_id, address)], "chain_id int, contract binary")
        return address, one, pages.of_cluster(self.events, address, self.chain_id)

    def leader(self, cluster: str, safety: str | None = None, as_of_block: int | None = None) -> DataFrame:
        point = self.at(safety, as_of_block)
        _, one, events = self._cluster(cluster)
        leaders = views.LEADER.replay(events, point.block_number)
        return as_hex(views.leader_for(one, leaders, point.block_number))

    def members(self, cluster: str, include_retired: bool = False, safety: str | None = None,
                as_of_block: int | None = None) -> DataFrame:
        point = self.at(safety, as_of_block)
        rows = views.MEMBERS.replay(self._cluster(cluster)[2], point.block_number, self._mine(self.blocks))
        return as_hex(views.in_member_order(views.active(rows, include_retired)))

    def member(self, cluster: str, member_id: str, safety: str | None = None,
               as_of_block: int | None = None) -> DataFrame:
        wanted = "0x" + parse_identifier(member_id, 32).hex()
        found = self.members(cluster, True, safety, as_of_block).where(F.col("member_id") == wanted)
        if found.isEmpty():
            raise NotFound(f"{cluster} has had no member {wanted}")
        return found

    def lifecycle(self, cluster: str, safety: str | None = None, as_of_block: int | None = None) -> DataFrame:
        point = self.at(safety, as_of_block)
        _, one, events = self._cluster(cluster)
        ended = views.LIFECYCLE.replay(events, point.block_number, self._mine(self.blocks))
        return as_hex(views.lifecycle_for(one, ended))

    def overview(self, cluster: str, safety: str | None = None, as_of_block: int | None = None) -> DataFrame:
        point = self.at(safety, as_of_block)
        _, one, events = self._cluster(cluster)
        return as_hex(views.overview(one, events, self._mine(self.blocks), point.block_number))

    def proof(self, cluster: str, view: str, safety: str | None = None,
              as_of_block: int | None = None) -> DataFrame:
        point = self.at(safety, as_of_block)
        return as_hex(pages.proof_events(self._cluster(cluster)[2], view, point.block_number))

    def event_page(self, cluster: str, since: int | None = None, kinds: str | None = None,
                   limit: int | None = None, safety: str | None = None,
                   as_of_block: int | None = None) -> tuple[DataFrame, int | None]:
        """(page, id to continue from)."""
        point = self.at(safety, as_of_block)
        page = pages.event_page(self.events, parse_identifier(cluster, 20), self.chain_id, since,
                                pages.parse_kinds(kinds), limit, point.block_number)
        return page, pages.next_since(page).first()["next_since"]

    def event(self, event_id: int) -> DataFrame:
        found = pages.event_by_id(self.events, event_id, self.chain_id)
        if found.isEmpty():
            raise NotFound(f"event id {event_id} not found")
        return found

    def factory_clusters(self, factory: str) -> DataFrame:
        return as_hex(registry.clusters_of(self._mine(self.watched), parse_identifier(factory, 20)))

    def factory_contains(self, factory: str, address: str) -> bool:
        probe = self._spark.createDataFrame(
            [(self.chain_id, parse_identifier(factory, 20), parse_identifier(address, 20))],
            "chain_id int, factory binary, address binary")
        return registry.contains(probe, self._mine(self.watched)).first()["contains"]

    def summary(self, shortname: str) -> DataFrame:
        chain = self._spark.createDataFrame([(shortname, self.chain_id)], "shortname string, chain_id int")
        return health.chain_summary(chain, self.state, self.events)

    def control_feed(self, cluster: str, member_id: str, since_nonce: int = 0,
                     confirmations: int = control.CONFIRMATIONS) -> DataFrame:
        """Frames for a connecting member: open holes, then its final instructions."""
        address = parse_identifier(cluster, 20)
        head = self._mine(self.state).select(F.coalesce("head", F.lit(0)).alias("head")).first()
        bound = max((head["head"] if head else 0) - confirmations, 0)
        backlog = control.member_backlog(self._mine(self.instructions), parse_identifier(member_id, 32),
                                         since_nonce, bound, address)
        holes = self._mine(self.holes).where(F.col("cluster") == F.lit(address))
        return control.connect_feed(holes, backlog)

    def delivery(self, initial: DataFrame | None = None) -> DataFrame:
        """Every instruction of the chain labelled by the strict orderer."""
        return orderer.order(self._mine(self.instructions), self.state, initial)

    def fingerprint(self, cluster: str, as_of_block: int) -> DataFrame:
        """Digest of the leader answer together with its as-of record."""
        request = self._spark.createDataFrame(
            [(0, self.chain_id, None, as_of_block)],
            "request_id int, chain_id int, safety string, as_of_block long")
        point = asof.resolve(request, self.state, self.blocks)
        _, one, events = self._cluster(cluster)
        answer = views.leader_for(one, views.LEADER.replay(events, as_of_block), as_of_block)
        return as_hex(audit.fingerprints(answer, audit.leader_json(), point))
