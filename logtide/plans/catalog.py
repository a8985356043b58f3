"""Every operator as a query over the sample tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logtide import schemas
from logtide.functions import hexes, numbers, payload as P
from logtide.operators import (
    asof, audit, control, decode, feeds, health, ingest, orderer, pages, registry, reorg, views,
)
from logtide.operators.render import as_hex
from logtide.plans import sample_sql as Q
from logtide.plans.backfill import backfill as cold_start
from logtide.session import per_chain, sized, work_dir
from logtide.sources import logs, sample_tables as S
from logtide.sources.raw_log import RawLog
from logtide.streaming import jobs, live

AS_OF = 360
EARLIER = 300
CONFIRMATIONS = control.CONFIRMATIONS
SAMPLE_BUCKET = 100  # the sample's chains have 720 heights
TICK_NOW = S.GENESIS_TS + 400 * S.BLOCK_SECONDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must agree."""
    def wrap(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return wrap


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return S.contract_events(spark, sf)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return S.raw_logs(S.with_chain_columns(S.table(spark, sf, "events")))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The block table: derived once per query, then read like any table."""
    return sized(S.blocks(spark, sf), "blocks")


def _heads(blocks: DataFrame) -> DataFrame:
    """Head per chain, as the small table it is in use."""
    return sized(blocks.groupBy("chain_id").agg(F.max("number").alias("head")), "heads")


def _sink(spark: SparkSession, sf: str) -> DataFrame:
    return control.add_instructions(control.instructions(_events(spark, sf))[0])


def _sunk(spark: SparkSession, sf: str) -> DataFrame:
    """The instruction table the sink keeps: written once, then read like any table."""
    return sized(_sink(spark, sf), "instructions")


def _instruction_clusters(rows: DataFrame) -> DataFrame:
    return rows.select("chain_id", "cluster").distinct()


# --- state views -----------------------------------------------------------

@query(Q.LEADER.format(bound=AS_OF))
def leader_as_of_block(spark: SparkSession, sf: str) -> DataFrame:
    leaders = views.LEADER.replay(_events(spark, sf), AS_OF)
    return as_hex(views.leader_for(S.clusters(spark, sf), leaders, AS_OF))


@query(Q.MEMBERS.format(bound=AS_OF))
def members_as_of_block(spark: SparkSession, sf: str) -> DataFrame:
    members = views.MEMBERS.replay(_events(spark, sf), AS_OF, _blocks(spark, sf))
    return as_hex(views.in_member_order(members))


@query(Q.MEMBERS.format(bound=AS_OF) + " WHERE tp IS NULL OR tp <= sp")
def active_members(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(views.active(views.MEMBERS.replay(_events(spark, sf), AS_OF, _blocks(spark, sf))))


@query(Q.MEMBERS.format(bound=AS_OF) + " WHERE a.member_id = printf('0x%064x', 3)")
def member_detail(spark: SparkSession, sf: str) -> DataFrame:
    members = views.MEMBERS.replay(_events(spark, sf), AS_OF, _blocks(spark, sf))
    return as_hex(members.where(F.col("member_id") == hexes.word(F.lit(3))))


@query(Q.LIFECYCLE.format(bound=AS_OF))
def lifecycle_as_of_block(spark: SparkSession, sf: str) -> DataFrame:
    ended = views.LIFECYCLE.replay(_events(spark, sf), AS_OF, _blocks(spark, sf))
    return as_hex(views.lifecycle_for(S.clusters(spark, sf), ended))


def _many_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests (request_id, chain_id, contract, as_of_block): every 23rd event asks for its cluster half-way down its chain."""
    return _events(spark, sf).where(F.col("event_id") % 23 == 0).select(
        F.col("event_id").alias("request_id"), "chain_id", "contract", F.floor(F.col("block_number") / 2).alias("as_of_block"))


MANY = """, req AS (SELECT event_id AS request_id, chain_id, contract, block_number // 2 AS as_of_block FROM ev WHERE event_id % 23 = 0)
"""


@query(Q.EV + MANY + """SELECT request_id, r.chain_id, r.contract, as_of_block, member_id, CAST(k AS BIGINT) AS epoch, block_number AS claimed_block
FROM req r JOIN ev ON ev.chain_id = r.chain_id AND ev.contract = r.contract AND block_number <= as_of_block
WHERE kind = 'LeaderClaimed' AND NOT removed QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k DESC, pos) = 1""")
def leader_as_of_many_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Hundreds of clusters, each as of a block of its own, in one job."""
    found = views.as_of_many(views.LEADER, _events(spark, sf), _many_blocks(spark, sf), bucket_blocks=SAMPLE_BUCKET)
    return as_hex(found.select("request_id", "chain_id", "contract", "as_of_block", "member_id", "epoch", "claimed_block"))


@query(Q.EV + MANY + """, m AS (SELECT request_id, as_of_block, ev.* FROM req r JOIN ev ON ev.chain_id = r.chain_id AND ev.contract = r.contract AND block_number <= as_of_block
 WHERE kind IN ('MemberRegistered', 'PublicEndpointUpdated', 'MemberRetired') AND NOT removed),
a AS (SELECT request_id, chain_id, contract, as_of_block, member_id, min(pos) FILTER (kind <> 'MemberRetired') AS seen,
 arg_max(k, pos) FILTER (kind = 'MemberRegistered') AS reg_k, arg_max(block_ts, pos) FILTER (kind = 'MemberRegistered') AS registered_at,
 arg_max(k, pos) FILTER (kind = 'PublicEndpointUpdated') AS end_k, max(pos) FILTER (kind = 'MemberRetired') AS ret_pos,
 arg_max(block_ts, pos) FILTER (kind = 'MemberRetired') AS ret_ts FROM m GROUP BY ALL)
SELECT request_id, chain_id, contract, as_of_block, member_id, 'node-' || reg_k AS dns_label, 'https://m' || end_k || '.example' AS public_endpoint,
 registered_at, CASE WHEN ret_pos > seen THEN ret_ts END AS retired_at FROM a WHERE seen IS NOT NULL""")
def members_as_of_many_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = views.as_of_many(views.MEMBERS, _events(spark, sf), _many_blocks(spark, sf), _blocks(spark, sf), SAMPLE_BUCKET)
    return as_hex(found.select("request_id", "chain_id", "contract", "as_of_block", "member_id", "dns_label", "public_endpoint",
                               "registered_at", "retired_at"))


@query(Q.EV + MANY + """SELECT request_id, r.chain_id, r.contract, as_of_block, min(block_ts) AS destroyed_at
FROM req r JOIN ev ON ev.chain_id = r.chain_id AND ev.contract = r.contract AND block_number <= as_of_block
WHERE kind = 'ClusterDestroyed' AND NOT removed GROUP BY ALL""")
def lifecycle_as_of_many_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = views.as_of_many(views.LIFECYCLE, _events(spark, sf), _many_blocks(spark, sf), _blocks(spark, sf), SAMPLE_BUCKET)
    return as_hex(found.select("request_id", "chain_id", "contract", "as_of_block", "destroyed_at"))


@query(Q.OVERVIEW.format(bound=AS_OF))
def cluster_overview(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(views.overview(S.clusters(spark, sf), _events(spark, sf), _blocks(spark, sf), AS_OF))


@query(Q.EV + """
SELECT chain_id, contract, CAST(k AS BIGINT) AS epoch, count(*) AS claims FROM ev
WHERE kind = 'LeaderClaimed' AND NOT removed GROUP BY ALL HAVING count(DISTINCT member_id) > 1""")
def leader_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(views.leader_conflicts(_events(spark, sf)))


@query(Q.EV + """, a AS (SELECT chain_id, contract, member_id,
 min(pos) FILTER (kind = 'MemberRegistered') rp, min(pos) FILTER (kind = 'PublicEndpointUpdated') ep,
 min(pos) FILTER (kind = 'MemberRetired') tp FROM ev
 WHERE NOT removed AND kind IN ('MemberRegistered', 'PublicEndpointUpdated', 'MemberRetired') GROUP BY ALL),
f AS (SELECT chain_id, contract, member_id,
 ep IS NOT NULL AND (rp IS NULL OR ep < rp) AS endpoint_before_register,
 tp IS NOT NULL AND (coalesce(rp, ep) IS NULL OR tp < least(coalesce(rp, ep), coalesce(ep, rp))) AS retire_of_unknown
 FROM a)
SELECT * FROM f WHERE endpoint_before_register OR retire_of_unknown""")
def member_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(views.member_anomalies(_events(spark, sf), _blocks(spark, sf)))


def _in_batches(view: views.StateView, events: DataFrame, blocks: DataFrame) -> DataFrame:
    """State kept over two overlapping deliveries, the later blocks first."""
    late = view.partial(view.events(events.where(F.col("block_number") >= EARLIER), None, blocks))
    state = view.apply(late, events.where(F.col("block_number") <= AS_OF), blocks)
    return view.finish(state, blocks)


@query(Q.LEADER_ROWS.format(bound=S.HEAD))
def leader_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_in_batches(views.LEADER, _events(spark, sf), _blocks(spark, sf)))


@query(Q.MEMBERS.format(bound=S.HEAD))
def members_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_in_batches(views.MEMBERS, _events(spark, sf), _blocks(spark, sf)))


@query(Q.LIFECYCLE_ROWS.format(bound=S.HEAD))
def lifecycle_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_in_batches(views.LIFECYCLE, _events(spark, sf), _blocks(spark, sf)))


# --- as-of resolution ------------------------------------------------------

def _requests(blocks: DataFrame) -> DataFrame:
    """Five read requests per chain, one of them past the head."""
    asks = [("head", None), ("finalized", None), (None, AS_OF), (None, 0), (None, 100000)]
    ask = F.explode(F.array(*[F.struct(
        F.lit(i).alias("n"), F.lit(s).cast("string").alias("safety"),
        F.lit(b).cast("long").alias("as_of_block")) for i, (s, b) in enumerate(asks)])).alias("ask")
    return _heads(blocks).select("chain_id", ask).select(
        (F.col("chain_id") * 10 + F.col("ask.n")).alias("request_id"), "chain_id",
        "ask.safety", "ask.as_of_block")


@query(Q.BLOCKS + """, st AS (SELECT chain_id, max(number) AS head FROM blk GROUP BY 1),
asks(n, safety, as_of_block) AS (VALUES (0, 'head', NULL), (1, 'finalized', NULL), (2, NULL, 360), (3, NULL, 0), (4, NULL, 100000)),
r AS (SELECT CAST(chain_id * 10 + n AS INTEGER) AS request_id, chain_id, head,
 CAST(coalesce(as_of_block, CASE WHEN safety = 'finalized' THEN head - 12 ELSE head END) AS BIGINT) AS block_number,
 CAST(head - 12 AS BIGINT) AS finalized_block,
 CASE WHEN as_of_block IS NULL THEN safety ELSE 'head' END AS safety, as_of_block > head AS past FROM st, asks)
SELECT request_id, r.chain_id, block_number, CASE WHEN past IS NOT TRUE THEN hash END AS block_hash,
 CASE WHEN past IS NOT TRUE THEN block_ts END AS block_timestamp, finalized_block, safety,
 CASE WHEN past THEN 'past_head' WHEN hash IS NULL THEN 'no_block_row' ELSE 'ok' END AS status
FROM r LEFT JOIN blk ON blk.chain_id = r.chain_id AND blk.number = r.block_number""")
def as_of_resolution(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf)
    state = ingest.chain_state(blocks, CONFIRMATIONS)
    return as_hex(asof.resolve(_requests(blocks), state, blocks))


@query(Q.EV + f""", st AS (SELECT chain_id, max(block_number) AS head FROM ev GROUP BY 1),
r AS (SELECT event_id AS request_id, ev.chain_id, head, CASE k % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'finalized' WHEN 2 THEN 'latest' END AS safety,
 CASE WHEN event_id % 3 = 0 THEN block_number END AS as_of_block, block_number FROM ev JOIN st USING (chain_id))
SELECT request_id, chain_id, coalesce(safety, 'head') AS safety,
 CASE WHEN safety IS NOT NULL AND as_of_block IS NOT NULL THEN 'both_given' WHEN safety = 'latest' THEN 'unknown_safety' ELSE 'ok' END AS status,
 CASE WHEN safety IS NOT NULL AND as_of_block IS NOT NULL OR safety = 'latest' THEN NULL
  WHEN as_of_block IS NOT NULL THEN as_of_block WHEN safety = 'finalized' THEN head - {CONFIRMATIONS} ELSE head END AS block_number FROM r
WHERE as_of_block IS NULL OR safety IS NULL
UNION ALL SELECT request_id, chain_id, 'head', 'both_given', NULL FROM r WHERE as_of_block IS NOT NULL AND safety IS NOT NULL""")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """A request for every event, good and bad ones, each with its status."""
    events, blocks = S.with_chain_columns(S.table(spark, sf, "events")), _blocks(spark, sf)
    k = F.col("k") % 4
    requests = events.select(
        F.col("event_id").alias("request_id"), "chain_id",
        F.when(k == 0, F.lit("head")).when(k == 1, F.lit("finalized")).when(k == 2, F.lit("latest")).alias("safety"),
        F.when(F.col("event_id") % 3 == 0, F.col("block_number")).alias("as_of_block"))
    found = asof.resolve(requests, per_chain(ingest.chain_state(blocks, CONFIRMATIONS)), blocks)
    return found.where(F.col("status") != "no_block_row").select("request_id", "chain_id", "safety", "status", "block_number").unionByName(
        found.where(F.col("status") == "no_block_row").select("request_id", "chain_id", "safety", F.lit("ok").alias("status"), "block_number"))


@query(Q.EV + """, st AS (SELECT chain_id, max(block_number) - 12 AS bound FROM ev GROUP BY 1),
c AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.chain_id, contract ORDER BY k DESC, pos) AS rn
 FROM ev JOIN st USING (chain_id) WHERE kind = 'LeaderClaimed' AND NOT removed AND block_number <= bound)
SELECT chain_id, contract, member_id, CAST(k AS BIGINT) AS epoch, block_number AS claimed_block FROM c WHERE rn = 1""")
def leader_at_finalized(spark: SparkSession, sf: str) -> DataFrame:
    state = ingest.chain_state(_blocks(spark, sf), CONFIRMATIONS)
    bound = state.select("chain_id", F.col("finalized").alias("as_of_block"))
    return as_hex(views.LEADER.replay(_events(spark, sf), bound))


# --- log upkeep ------------------------------------------------------------

EVENT_COLUMNS = ["event_id", "chain_id", "contract", "block_number", "block_hash", "log_index", "tx_hash", "kind"]
EVENT_SQL = ("event_id, chain_id, contract, block_number, block_hash, log_index, "
             "'0x' || sha256('t' || event_id) AS tx_hash, kind")


@query(Q.EV + f"SELECT {EVENT_SQL} FROM ev")
def event_append_dedup(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = S.redelivered(_events(spark, sf).select(*EVENT_COLUMNS)).drop("delivery")
    return as_hex(ingest.append_events(arrivals))


@query(Q.EV + f"SELECT {EVENT_SQL} FROM ev WHERE block_number > {AS_OF}")
def event_append_new_only(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).select(*EVENT_COLUMNS)
    stored = events.where(F.col("block_number") <= AS_OF)
    return as_hex(ingest.append_events(S.redelivered(events).drop("delivery"), stored))


@query(Q.EV + """SELECT chain_id, CAST(sum(1 + CAST(event_id % 50 = 0 AS INT)) AS BIGINT) AS received,
 count(*) AS ingested, CAST(sum(CAST(event_id % 50 = 0 AS INT)) AS BIGINT) AS duplicates FROM ev GROUP BY 1""")
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.count_duplicates(S.redelivered(_events(spark, sf)))


@query(Q.BLOCKS + """SELECT chain_id, number, hash, parent_hash, block_ts,
 CASE WHEN number % 97 = 0 THEN '0x' || sha256('x' || number) END AS previous_hash FROM blk""")
def block_upsert(spark: SparkSession, sf: str) -> DataFrame:
    headers = _blocks(spark, sf)
    incoming = headers.withColumn("seq", F.col("number"))
    return as_hex(ingest.upsert_blocks(S.stored_blocks(headers), incoming))


@query(Q.BLOCKS + """SELECT chain_id, number,
 CASE WHEN number % 97 = 0 THEN '0x' || sha256('x' || number) ELSE hash END AS hash,
 CASE WHEN number % 97 = 0 THEN printf('0x%064x', 0) ELSE parent_hash END AS parent_hash,
 CASE WHEN number % 97 = 0 THEN 0 ELSE block_ts END AS block_ts,
 CASE WHEN number % 97 = 0 THEN hash END AS previous_hash FROM blk""")
def block_upsert_from_logs(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(ingest.upsert_blocks(_blocks(spark, sf), ingest.blocks_from_logs(_events(spark, sf))))


@query(Q.EV + """SELECT chain_id, contract, max(block_number) + 1 AS next_block FROM ev GROUP BY ALL""")
def cursor_advance(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    reached = lambda rows: rows.groupBy("chain_id", "contract").agg(
        (F.max("block_number") + 1).alias("next_block"))
    early, late = (reached(events.where(c)) for c in (F.col("block_number") <= AS_OF,
                                                      F.col("block_number") > EARLIER))
    return as_hex(ingest.advance_cursors(early, late))


def _order_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Stored cursors of the sample clusters, from the customers that have orders."""
    placed = S.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderkey") % 900).alias("n"))
    return placed.select(F.lit(1).alias("chain_id"), hexes.word(F.col("o_custkey") + 1000, 20).alias("contract"),
                         F.col("n").alias("next_block"))


@query("""WITH cur AS (SELECT o_custkey, max(o_orderkey % 900) AS n FROM orders GROUP BY 1),
w AS (SELECT n_nationkey AS a FROM nation UNION ALL SELECT c_custkey + 1000 FROM customer)
SELECT CAST(1 AS INTEGER) AS chain_id, printf('0x%040x', CAST(a AS BIGINT)) AS contract, CAST(coalesce(n, 0) AS BIGINT) AS next_block
FROM w LEFT JOIN cur ON cur.o_custkey + 1000 = w.a""")
def cursor_read(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(ingest.read_cursors(S.watched(spark, sf), _order_cursors(spark, sf)))


PLAN_SQL = """WITH cur AS (SELECT o_custkey + 1000 AS a, max(o_orderkey % 900) AS n FROM orders GROUP BY 1),
w AS (SELECT CAST(n_nationkey AS BIGINT) AS a, 'factory' AS kind, 0 AS f FROM nation
 UNION ALL SELECT c_custkey + 1000, 'cluster_diamond', c_custkey % 720 FROM customer),
hd AS (SELECT max((day(ts) - 1) * 24 + hour(ts)) AS head FROM events WHERE user_id % 2 + 1 = 1),
p AS (SELECT CAST(1 AS INTEGER) AS chain_id, printf('0x%040x', w.a) AS contract, kind,
 CAST(greatest(coalesce(n, 0), f) AS BIGINT) AS from_block, CAST(head AS BIGINT) AS to_block
 FROM w LEFT JOIN cur USING (a), hd WHERE greatest(coalesce(n, 0), f) <= head)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(_blocks(spark, sf))
    return ingest.plan_backfill(S.watched(spark, sf), _order_cursors(spark, sf), heads)


@query(PLAN_SQL + "SELECT * FROM p")
def backfill_plan(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_plan(spark, sf))


@query(PLAN_SQL + """SELECT p.*, CAST(s AS BIGINT) AS chunk_start, least(CAST(s AS BIGINT) + 99, to_block) AS chunk_end
FROM p, unnest(generate_series(from_block, to_block, 100)) AS u(s)""")
def backfill_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(ingest.split_chunks(_plan(spark, sf), 100))


@query(Q.EV + """SELECT event_id, chain_id, contract AS address, block_number FROM ev
WHERE block_number BETWEEN 100 AND 600 AND kind IN ('LeaderClaimed', 'MemberRegistered')
 AND user_id IN (SELECT s_suppkey FROM supplier)""")
def log_scan(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [s.topic0 for s in decode.DEFAULT_SPECS if s.kind in ("LeaderClaimed", "MemberRegistered")]
    suppliers = S.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 2 + 1).cast("int").alias("chain_id"), hexes.word(F.col("s_suppkey"), 20).alias("address"))
    return as_hex(ingest.scan_logs(_raw(spark, sf), wanted, 100, 600, suppliers).select(
        "event_id", "chain_id", "address", "block_number"))


def _raw_table(spark: SparkSession, sf: str) -> RawLog:
    table = RawLog(spark, work_dir(spark, "raw-log"), SAMPLE_BUCKET)
    table.append(_raw(spark, sf))
    return table


@query(ORACLES["log_scan"])
def log_scan_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same scan over the raw log's own layout."""
    wanted = [s.topic0 for s in decode.DEFAULT_SPECS if s.kind in ("LeaderClaimed", "MemberRegistered")]
    suppliers = S.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 2 + 1).cast("int").alias("chain_id"), hexes.word(F.col("s_suppkey"), 20).alias("address"))
    return as_hex(_raw_table(spark, sf).scan(wanted, 100, 600, suppliers).select("event_id", "chain_id", "address", "block_number"))


@query(Q.EV + """, r AS (SELECT chain_id, contract, max(block_number) AS f FROM ev WHERE kind = 'ClusterDestroyed' GROUP BY ALL)
SELECT event_id, chain_id, contract AS address, block_number FROM ev JOIN r USING (chain_id, contract) WHERE block_number >= f""")
def log_since_block(spark: SparkSession, sf: str) -> DataFrame:
    """What contracts emitted from a block of their own on, as the backlog of newly found ones is read."""
    contracts = _events(spark, sf).where(F.col("kind") == "ClusterDestroyed").groupBy("chain_id", F.col("contract").alias("address")).agg(
        F.max("block_number").alias("from_block"))
    return as_hex(_raw_table(spark, sf).since(contracts).select("event_id", "chain_id", "address", "block_number"))


@query(Q.EV + """, r AS (SELECT chain_id, contract, max(block_number) FILTER (kind = 'MemberRetired') AS f FROM ev GROUP BY ALL)
SELECT event_id, chain_id, contract AS address, block_number FROM ev JOIN r USING (chain_id, contract)
WHERE block_number BETWEEN f AND 719""")
def log_scan_by_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = _events(spark, sf).groupBy("chain_id", "contract").agg(
        F.max(F.when(F.col("kind") == "MemberRetired", F.col("block_number"))).alias("from_block")
    ).withColumn("to_block", F.lit(S.HEAD))
    topics = [s.topic0 for s in decode.DEFAULT_SPECS]
    return as_hex(ingest.scan_plan(_raw(spark, sf), plan, topics).select(
        "event_id", "chain_id", "address", "block_number"))


@query(Q.BLOCKS + """SELECT chain_id, max(number) AS head, CAST(max(number) - 12 AS BIGINT) AS finalized FROM blk GROUP BY 1""")
def chain_state(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.chain_state(_blocks(spark, sf), CONFIRMATIONS)


# --- decoding --------------------------------------------------------------

def _decoded(spark: SparkSession, sf: str, kind: str, *fields: str) -> DataFrame:
    events, _ = decode.decode_logs(_raw(spark, sf))
    d = F.col("decoded")
    return as_hex(events.where(F.col("kind") == kind).select("event_id", *[d[f].alias(f) for f in fields]))


@query(Q.EV + """SELECT event_id, member_id AS "memberId", printf('0x%040x', k + 1) AS "instanceId",
 printf('0x%040x', k + 2) AS passthrough, 'node-' || k AS "dnsLabel" FROM ev WHERE kind = 'MemberRegistered'""")
def decode_member_registered(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "MemberRegistered", "memberId", "instanceId", "passthrough", "dnsLabel")


@query(Q.EV + """SELECT event_id, member_id AS "memberId", CAST(k AS VARCHAR) AS epoch, endpoint_hex AS endpoint
FROM ev WHERE kind = 'LeaderClaimed'""")
def decode_leader_claimed(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "LeaderClaimed", "memberId", "epoch", "endpoint")


@query(Q.EV + """SELECT event_id, member_id AS "memberId", endpoint_hex AS "publicEndpoint"
FROM ev WHERE kind = 'PublicEndpointUpdated'""")
def decode_public_endpoint_updated(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "PublicEndpointUpdated", "memberId", "publicEndpoint")


@query(Q.EV + """SELECT event_id, member_id AS "memberId", CAST(block_ts AS VARCHAR) AS "timestamp"
FROM ev WHERE kind = 'MemberRetired'""")
def decode_member_retired(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "MemberRetired", "memberId", "timestamp")


@query(Q.EV + """SELECT event_id, CAST(block_ts AS VARCHAR) AS "timestamp" FROM ev WHERE kind = 'ClusterDestroyed'""")
def decode_cluster_destroyed(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "ClusterDestroyed", "timestamp")


@query(Q.EV + """SELECT event_id, '0x' || sha256('i' || event_id) AS "instructionId", printf('0x%064x', user_id) AS "clusterId",
 CAST(k AS VARCHAR) AS nonce, targets AS "targetMembers", CAST(expiry AS VARCHAR) AS expiry, printf('0x%064x', k) AS salt,
 '0x' || sha256('c' || event_id) AS "ciphertextHash", printf('0x%016x', event_id) AS ciphertext
FROM ev WHERE kind = 'ControlInstructionBroadcast'""")
def decode_control_instruction(spark: SparkSession, sf: str) -> DataFrame:
    rows = _decoded(spark, sf, "ControlInstructionBroadcast", "instructionId", "clusterId", "nonce",
                    "targetMembers", "expiry", "salt", "ciphertextHash", "ciphertext")
    return rows.withColumns({"targetMembers": F.concat_ws(",", "targetMembers"),
                             "nonce": F.col("nonce").cast("string"), "expiry": F.col("expiry").cast("string")})


@query("""SELECT c_custkey AS event_id, printf('0x%040x', c_custkey + 1000) AS diamond,
 printf('0x%040x', CAST(c_nationkey AS BIGINT)) AS deployer, printf('0x%064x', c_custkey) AS salt FROM customer""")
def decode_cluster_deployed(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = decode.decode_logs(S.deployment_logs(spark, sf))
    d = F.col("decoded")
    return as_hex(events.where(F.col("kind") == "ClusterDeployed").select(
        "event_id", *[d[f].alias(f) for f in ("diamond", "deployer", "salt")]))


@query(Q.ACKS + """SELECT row_id AS event_id, printf('0x%064x', l_partkey) AS "instructionId", job_id AS "jobId",
 member_id AS "memberId", status, CAST(seq AS VARCHAR) AS seq, pointer AS "logPointer", summary FROM ak""")
def decode_control_ack(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = decode.decode_logs(S.ack_logs(spark, sf))
    d = F.col("decoded")
    fields = ("instructionId", "jobId", "memberId", "status", "seq", "logPointer", "summary")
    rows = as_hex(events.where(F.col("kind") == "ControlAck").select("event_id", *[d[f].alias(f) for f in fields]))
    return rows.withColumns({"seq": F.col("seq").cast("string"), "status": F.col("status").cast("int")})


@query(Q.EV + """SELECT event_id, CASE WHEN block_number % 97 = 0 THEN 'no tx_hash'
 ELSE 'first topic absent' END AS reject_reason FROM ev WHERE block_number % 97 = 0 OR kind = 'MemberRetired'""")
def raw_log_rejects(spark: SparkSession, sf: str) -> DataFrame:
    damaged = S.with_chain_columns(S.table(spark, sf, "events")).select(
        "event_id", "chain_id", F.col("contract").alias("address"),
        F.when(F.col("kind") == "MemberRetired", F.array().cast("array<binary>")).otherwise(
            F.array(F.lit(bytes(32)))).alias("topics"),
        F.lit(b"").alias("data"), "block_number", "block_hash",
        F.when(F.col("block_number") % S.ORPHAN_EVERY != 0, F.col("tx_hash")).alias("tx_hash"), "log_index")
    _, rejects = decode.split_rejects(damaged)
    return rejects.select("event_id", "reject_reason")


@query(Q.EV + """SELECT event_id, kind AS kind_after, CASE WHEN kind <> 'LeaderClaimed' THEN kind END AS kind_before,
 CASE WHEN kind = 'LeaderClaimed' THEN CAST(k AS VARCHAR) END AS epoch FROM ev""")
def late_decode(spark: SparkSession, sf: str) -> DataFrame:
    older = [s for s in decode.DEFAULT_SPECS if s.kind != "LeaderClaimed"]
    events, _ = decode.decode_logs(_raw(spark, sf), older)
    tracked = events.withColumn("kind_before", F.col("kind"))
    return decode.decode_late(tracked, decode.DEFAULT_SPECS).select(
        "event_id", F.col("kind").alias("kind_after"), "kind_before", F.col("decoded.epoch").alias("epoch"))


@query(Q.EV + """SELECT event_id, CASE kind
 WHEN 'LeaderClaimed' THEN member_id || ':' || k || ':' || endpoint_hex
 WHEN 'MemberRegistered' THEN member_id || ':' || printf('0x%040x', k + 1) || ':node-' || k
 WHEN 'ControlInstructionBroadcast' THEN k || ':' || expiry || ':' || targets
 WHEN 'PublicEndpointUpdated' THEN member_id || ':' || endpoint_hex
 WHEN 'MemberRetired' THEN member_id || ':' || block_ts ELSE CAST(block_ts AS VARCHAR) END AS fields FROM ev""")
def payload_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    text = decode.payload_json(F.col("kind"), F.col("decoded"))
    stored = _events(spark, sf).select("event_id", "kind", text.alias("json"))
    back = stored.select("event_id", "kind", F.inline(F.array(F.struct(
        decode.payload_from_json(F.col("kind"), F.col("json")).alias("d")))))
    d, kind, hex0x = F.col("d"), F.col("kind"), hexes.hex0x
    join = lambda *parts: F.concat_ws(":", *[p.cast("string") for p in parts])
    fields = (
        F.when(kind == "LeaderClaimed", join(hex0x(d["memberId"]), d["epoch"], hex0x(d["endpoint"])))
        .when(kind == "MemberRegistered", join(hex0x(d["memberId"]), hex0x(d["instanceId"]), d["dnsLabel"]))
        .when(kind == "ControlInstructionBroadcast", F.concat_ws(":", d["nonce"].cast("string"), d["expiry"].cast("string"),
              F.concat_ws(",", F.transform(d["targetMembers"], hex0x))))
        .when(kind == "PublicEndpointUpdated", join(hex0x(d["memberId"]), hex0x(d["publicEndpoint"])))
        .when(kind == "MemberRetired", join(hex0x(d["memberId"]), d["timestamp"])).otherwise(d["timestamp"])
    )
    return back.select("event_id", fields.alias("fields"))


@query("""SELECT event_id, CAST(CAST(event_id + 1 AS HUGEINT) * CAST(1208925819614629174706176 AS HUGEINT) AS VARCHAR) AS wide,
 CAST(event_id * 1000003 AS VARCHAR) AS narrow FROM events""")
def uint256_text(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.concat(F.lit(bytes(14)), hexes.word(F.col("event_id") + 1, 8), F.lit(bytes(10)))
    return S.table(spark, sf, "events").select(
        "event_id", numbers.uint256_text(shifted).alias("wide"),
        numbers.uint256_text(hexes.word(F.col("event_id") * 1000003)).alias("narrow"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL ELSE event_id END AS as_int,
 CASE WHEN user_id % 3 = 0 THEN event_id END AS as_uint64, CAST(user_id % 100 AS INTEGER) AS as_uint8,
 CASE WHEN user_id % 2 = 0 THEN printf('0x%064x', event_id) END AS as_bytes32,
 'missing' AS absent, 'not_string' AS wrong_type FROM events""")
def scalar_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """Payload text with hex, decimal and broken numbers, read field by field."""
    event, user = F.col("event_id"), F.col("user_id")
    number = (F.when(user % 3 == 0, event.cast("string"))
              .when(user % 3 == 1, F.concat(F.lit("0X"), F.hex(event))).otherwise(F.lit("0xzz")))
    word = F.when(user % 2 == 0, F.hex(hexes.word(event))).otherwise(F.lit("0x12"))
    body = F.to_json(F.struct(number.alias("n"), (user % 100).alias("small"), word.alias("w")))
    rows = S.table(spark, sf, "events").select("event_id", F.inline(F.array(F.struct(P.parse(body).alias("v")))))
    v = F.col("v")
    return rows.select(
        "event_id", numbers.parse_uint_as_int64(P.get_string(v, "n")).alias("as_int"),
        numbers.narrow_int64(P.get_uint64(v, "n")).alias("as_uint64"),
        P.get_uint8(v, "small").cast("int").alias("as_uint8"),
        hexes.hex0x(P.get_bytes32(v, "w")).alias("as_bytes32"),
        P.field_error(v, "nothing").alias("absent"), P.field_error(v, "small").alias("wrong_type"))


@query("SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS INTEGER) AS bytes, 'plain' AS bare FROM documents")
def text_from_hex(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts through hex and back, and unprefixed text passed through."""
    shown = hexes.hex_field_as_text(hexes.hex0x(F.encode("text", "UTF-8")))
    return S.table(spark, sf, "documents").select("doc_id", shown.alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.octet_length("t").alias("bytes"),
        hexes.hex_field_as_text(F.lit("plain")).alias("bare"))


# --- reorganisation --------------------------------------------------------

@query(Q.BLOCKS + """SELECT h.chain_id, h.number, coalesce(bool_or(s.number = h.number - 1 AND s.number % 97 = 0), false) AS parent_mismatch,
 coalesce(bool_or(s.number = h.number AND s.number % 97 = 0), false) AS hash_changed
FROM blk h JOIN blk s ON s.chain_id = h.chain_id AND s.number IN (h.number, h.number - 1)
GROUP BY ALL HAVING parent_mismatch OR hash_changed""")
def reorg_detection(spark: SparkSession, sf: str) -> DataFrame:
    headers = _blocks(spark, sf)
    return reorg.detect(headers, S.stored_blocks(headers))


@query(Q.BLOCKS + """SELECT chain_id, number AS head, CASE WHEN number % 97 = 0 AND number > 0 THEN number - 1
 WHEN number = 0 THEN 0 ELSE number END AS ancestor, 'OK' AS status FROM blk""")
def common_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored block taken in turn as the head where a fork was seen."""
    headers = _blocks(spark, sf)
    heads = headers.select("chain_id", F.col("number").alias("head"))
    return reorg.common_ancestor(heads, S.stored_blocks(headers), headers, CONFIRMATIONS)


@query(Q.EV + "SELECT event_id, chain_id, block_number, removed FROM ev")
def removed_from_canonical_chain(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).withColumn("removed", F.lit(False))
    orphans = reorg.orphan_blocks(events, _blocks(spark, sf))
    return reorg.mark_removed(events, orphans).select("event_id", "chain_id", "block_number", "removed")


@query(Q.EV + "SELECT event_id, chain_id, block_number FROM ev WHERE NOT removed")
def canonical_survivors(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    orphans = reorg.orphan_blocks(events, _blocks(spark, sf))
    return reorg.survivors(events, orphans).select("event_id", "chain_id", "block_number")


@query(Q.EV + """SELECT chain_id, count(*) FILTER (block_number > 600 + chain_id AND NOT removed) AS removed_rows
FROM ev GROUP BY 1""")
def rollback_counts(spark: SparkSession, sf: str) -> DataFrame:
    ancestors = _heads(_blocks(spark, sf)).select("chain_id", (F.col("chain_id") + 600).cast("long").alias("ancestor"))
    return reorg.rollback_counts(reorg.roll_back(_events(spark, sf), ancestors))


# --- registry --------------------------------------------------------------

@query("""SELECT CAST(1 AS INTEGER) AS chain_id, printf('0x%040x', o_orderkey % 25) AS factory,
 printf('0x%040x', o_custkey + 1000) AS address, c_custkey IS NOT NULL AS contains
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25""")
def factory_membership(spark: SparkSession, sf: str) -> DataFrame:
    probes = S.table(spark, sf, "orders").select(
        F.lit(1).alias("chain_id"), hexes.word(F.col("o_orderkey") % 25, 20).alias("factory"),
        hexes.word(F.col("o_custkey") + 1000, 20).alias("address"))
    return as_hex(registry.contains(probes, S.watched(spark, sf)))


@query("""SELECT CAST(1 AS INTEGER) AS chain_id, printf('0x%040x', CAST(c_nationkey AS BIGINT)) AS factory,
 printf('0x%040x', c_custkey + 1000) AS address, c_custkey % 720 AS from_block FROM customer""")
def factory_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(registry.clusters_of(S.watched(spark, sf)))


WATCHED_SQL = """SELECT CAST(1 AS INTEGER) AS chain_id, printf('0x%040x', CAST(n_nationkey AS BIGINT)) AS address, 'factory' AS kind,
 CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS from_block FROM nation UNION ALL
SELECT 1, printf('0x%040x', c_custkey + 1000), 'cluster_diamond', printf('0x%040x', CAST(c_nationkey AS BIGINT)), c_custkey % 720 FROM customer"""


@query(WATCHED_SQL)
def watched_listing(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(registry.listing(S.watched(spark, sf)))


@query(WATCHED_SQL)
def cluster_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Watched set rebuilt from deployment logs over the seeded factories."""
    events, _ = decode.decode_logs(S.deployment_logs(spark, sf))
    factories = S.watched(spark, sf).where(F.col("kind") == "factory")
    return as_hex(registry.rediscover(factories, events))


@query("""WITH s AS (SELECT s_suppkey + 1000 AS a, min(s_suppkey) AS f FROM supplier GROUP BY 1)
SELECT printf('0x%040x', coalesce(c_custkey + 1000, a)) AS address,
 CASE WHEN c_custkey IS NOT NULL THEN c_custkey % 720 ELSE f + 5000 END AS from_block
FROM customer FULL JOIN s ON a = c_custkey + 1000""")
def watched_registration(spark: SparkSession, sf: str) -> DataFrame:
    """Registering addresses that may already be watched keeps their first row."""
    held = S.watched(spark, sf).where(F.col("kind") == "cluster_diamond")
    added = S.table(spark, sf, "supplier").select(
        F.lit(1).alias("chain_id"), hexes.word(F.col("s_suppkey") + 1000, 20).alias("address"),
        F.lit("cluster_diamond").alias("kind"), F.lit(None).cast("binary").alias("parent"),
        (F.col("s_suppkey") + 5000).alias("from_block"))
    return as_hex(registry.register(held, added).select("address", "from_block"))


# --- pages and proofs ------------------------------------------------------

@query(Q.EV + """SELECT event_id, contract, block_number, log_index, kind FROM ev
WHERE NOT removed AND event_id > 20 AND block_number <= 700 AND kind IN ('LeaderClaimed', 'MemberRetired')
 AND user_id = 7 ORDER BY event_id LIMIT 25""")
def event_page(spark: SparkSession, sf: str) -> DataFrame:
    kinds = pages.parse_kinds("LeaderClaimed, ,MemberRetired")
    page = pages.event_page(_events(spark, sf), bytes(19) + bytes([7]), since=20, kinds=kinds, limit=25, as_of=700)
    return as_hex(page.select("event_id", "contract", "block_number", "log_index", "kind"))


@query(Q.EV + """, p AS (SELECT event_id, chain_id, contract, block_number, kind,
 row_number() OVER (PARTITION BY chain_id, contract ORDER BY event_id) AS rn FROM ev WHERE NOT removed AND event_id > 100)
SELECT event_id, chain_id, contract, block_number, kind, CAST(rn AS INTEGER) AS page_rank FROM p WHERE rn <= 20""")
def event_pages_all_clusters(spark: SparkSession, sf: str) -> DataFrame:
    paged = pages.event_pages(_events(spark, sf), since=100, limit=20)
    return as_hex(paged.select("event_id", "chain_id", "contract", "block_number", "kind", "page_rank"))


@query(Q.EV + "SELECT max(event_id) AS next_since FROM (SELECT event_id FROM ev WHERE NOT removed ORDER BY event_id LIMIT 100)")
def event_page_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return pages.next_since(pages.event_page(_events(spark, sf)))


@query(Q.EV + "SELECT event_id, chain_id, contract, block_number, kind, removed FROM ev WHERE event_id = 3")
def event_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(pages.event_by_id(_events(spark, sf), 3).select(
        "event_id", "chain_id", "contract", "block_number", "kind", "removed"))


def _proof(spark: SparkSession, sf: str, view: str) -> DataFrame:
    events, _ = decode.decode_logs(_raw(spark, sf))
    orphaned = events.withColumn("removed", F.col("block_number") % S.ORPHAN_EVERY == 0)
    rows = pages.proof_events(orphaned, view, AS_OF)
    return as_hex(rows.select("chain_id", "contract", "block_number", "log_index", "tx_hash", "topic0",
                              "topics_rest", F.sha2(F.col("data"), 256).alias("data_digest"), "kind"))


def _proof_sql(kinds: str, topics_rest: str, data: str, topic0: str) -> str:
    return Q.EV + f"""SELECT chain_id, contract, block_number, log_index, '0x' || sha256('t' || event_id) AS tx_hash,
 {topic0} AS topic0, {topics_rest} AS topics_rest, sha256(unhex({data})) AS data_digest, kind
FROM ev WHERE NOT removed AND block_number <= {AS_OF} AND kind IN ({kinds})"""


def _topic(kind: str) -> str:
    return next("0x" + s.topic0 for s in decode.DEFAULT_SPECS if s.kind == kind)


ENDPOINT_DATA = "printf('%064x', 32) || printf('%064x', strlen(endpoint)) || rpad(substr(endpoint_hex, 3), 64, '0')"


@query(_proof_sql("'LeaderClaimed'", "member_id || printf('%064x', k)", ENDPOINT_DATA, f"'{_topic('LeaderClaimed')}'"))
def leader_proof_events(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, "leader")


@query(_proof_sql(
    "'MemberRegistered', 'PublicEndpointUpdated', 'MemberRetired'",
    "member_id || CASE WHEN kind = 'MemberRegistered' THEN printf('%064x', k + 1) || printf('%064x', k + 2) ELSE '' END",
    f"""CASE kind WHEN 'MemberRetired' THEN printf('%064x', block_ts) WHEN 'PublicEndpointUpdated' THEN {ENDPOINT_DATA}
 ELSE printf('%064x', 32) || printf('%064x', strlen('node-' || k)) || rpad(lower(hex('node-' || k)), 64, '0') END""",
    f"""CASE kind WHEN 'MemberRetired' THEN '{_topic('MemberRetired')}' WHEN 'PublicEndpointUpdated'
 THEN '{_topic('PublicEndpointUpdated')}' ELSE '{_topic('MemberRegistered')}' END"""))
def member_proof_events(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, "members")


@query(_proof_sql("'ClusterDestroyed'", "'0x'", "printf('%064x', block_ts)", f"'{_topic('ClusterDestroyed')}'"))
def lifecycle_proof_events(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, "lifecycle")


# --- control plane ---------------------------------------------------------

@query(Q.EV + """SELECT event_id AS row_id, chain_id, contract AS cluster, '0x' || sha256('i' || event_id) AS instruction_id,
 CAST(k AS BIGINT) AS nonce, targets AS target_members, expiry, block_number, removed FROM ev
WHERE kind = 'ControlInstructionBroadcast'""")
def control_instructions(spark: SparkSession, sf: str) -> DataFrame:
    rows = control.instructions(_events(spark, sf))[0]
    return as_hex(rows.select("row_id", "chain_id", "cluster", "instruction_id", "nonce", "target_members",
                              "expiry", "block_number", "removed")).withColumn(
        "target_members", F.concat_ws(",", "target_members"))


ACK_COLUMNS = ["row_id", "cluster", "instruction_id", "job_id", "member_id", "status", "seq", "log_pointer", "summary"]
ACK_SQL = """row_id, cluster, printf('0x%064x', l_partkey) AS instruction_id, job_id, member_id,
 status, seq, CASE WHEN status <> 1 THEN pointer END AS log_pointer, CASE WHEN status <> 1 THEN summary END AS summary"""


def _acks(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = decode.decode_logs(S.ack_logs(spark, sf))
    return control.acks(events)[0]


def _ack_view(rows: DataFrame) -> DataFrame:
    return as_hex(rows.select(*ACK_COLUMNS)).withColumn("status", F.col("status").cast("int"))


@query(Q.ACKS + f"SELECT {ACK_SQL} FROM ak")
def control_acks(spark: SparkSession, sf: str) -> DataFrame:
    return _ack_view(_acks(spark, sf))


@query(Q.ACKS + f"""SELECT {ACK_SQL} FROM ak
QUALIFY row_number() OVER (PARTITION BY cluster, job_id, seq ORDER BY row_id) = 1""")
def ack_sink(spark: SparkSession, sf: str) -> DataFrame:
    return _ack_view(control.add_acks(_acks(spark, sf)))


@query(Q.ACKS + f"""SELECT {ACK_SQL} FROM ak
QUALIFY row_number() OVER (PARTITION BY cluster, job_id, seq, member_id ORDER BY row_id) = 1""")
def ack_sink_per_member(spark: SparkSession, sf: str) -> DataFrame:
    return _ack_view(control.add_acks(_acks(spark, sf), per_member=True))


@query(Q.SUNK + "SELECT row_id, chain_id, cluster, nonce, expiry, block_number FROM ins")
def instruction_sink(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_sink(spark, sf).select("row_id", "chain_id", "cluster", "nonce", "expiry", "block_number"))


@query(Q.ORDERED.format(initial="0", head="hd.head") + """SELECT row_id, chain_id, cluster, nonce, outcome,
 CAST(next_expected AS BIGINT) AS next_expected FROM lab""")
def instruction_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = orderer.order(_sunk(spark, sf), _heads(_blocks(spark, sf)))
    return as_hex(ordered.select("row_id", "chain_id", "cluster", "nonce", "outcome", "next_expected"))


@query(Q.ORDERED.format(initial="0", head="hd.head") + """SELECT chain_id, cluster, CAST(0 AS BIGINT) AS initial,
 CAST(max(next_expected) AS BIGINT) AS next_expected,
 max(nonce) FILTER (outcome = 'AwaitingPredecessor') AS highest_buffered,
 count(*) FILTER (outcome = 'AwaitingPredecessor') AS buffered FROM lab WHERE final GROUP BY ALL""")
def instruction_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(orderer.cursors(_sunk(spark, sf), _heads(_blocks(spark, sf))))


@query(Q.ORDERED.format(
    initial="coalesce((SELECT max(nonce) + 1 FROM ins i WHERE i.cluster = ins.cluster AND i.block_number <= 20), 0)",
    head="hd.head") + """SELECT row_id, chain_id, cluster, nonce, outcome,
 CAST(next_expected AS BIGINT) AS next_expected FROM lab""")
def instruction_order_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sunk(spark, sf)
    initial = control.start_cursors(rows, _instruction_clusters(rows), 20)
    ordered = orderer.order(rows, _heads(_blocks(spark, sf)), initial)
    return as_hex(ordered.select("row_id", "chain_id", "cluster", "nonce", "outcome", "next_expected"))


@query(Q.ORDERED.format(initial="0", head=str(EARLIER)) + """SELECT row_id, chain_id, cluster, nonce, outcome FROM lab""")
def instruction_finality(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(_blocks(spark, sf)).withColumn("head", F.lit(EARLIER).cast("long"))
    ordered = orderer.order(_sunk(spark, sf), heads)
    return as_hex(ordered.select("row_id", "chain_id", "cluster", "nonce", "outcome"))


@query(Q.SUNK + """SELECT chain_id, cluster, max(nonce) FILTER (block_number <= 200) AS highest_nonce FROM ins GROUP BY ALL""")
def highest_final_nonce(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sunk(spark, sf)
    return as_hex(control.highest_final_nonce(rows, _instruction_clusters(rows), 200))


@query(Q.SUNK + """SELECT row_id, chain_id, cluster, nonce, expiry, block_number FROM ins
WHERE nonce >= 10 AND block_number <= 600""")
def instructions_since(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(control.final_since(_sunk(spark, sf), 10, 600).select(
        "row_id", "chain_id", "cluster", "nonce", "expiry", "block_number"))


def _ordered_at(spark: SparkSession, sf: str, head: int | None) -> DataFrame:
    heads = _heads(_blocks(spark, sf))
    if head is not None:
        heads = heads.withColumn("head", F.lit(head).cast("long"))
    rows = _sunk(spark, sf).withColumn("buffered_at", S.block_ts(F.col("block_number")))
    return orderer.order(rows, heads)


@query(Q.HOLES + f"SELECT * FROM hole719")
def stalled_clusters(spark: SparkSession, sf: str) -> DataFrame:
    ordered = _ordered_at(spark, sf, S.HEAD)
    return as_hex(orderer.find_holes(ordered, TICK_NOW, max_buffer=5, max_age=1000 * S.BLOCK_SECONDS))


def _first_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Hole table after a first tick at an earlier head."""
    ordered = _ordered_at(spark, sf, EARLIER)
    found = orderer.find_holes(ordered, TICK_NOW, max_buffer=5, max_age=1000 * S.BLOCK_SECONDS)
    return found.withColumns({"observed_at": F.lit(1000).cast("long"), "resolved_at": F.lit(None).cast("long")})


@query(Q.HOLES + f""", a AS (SELECT * FROM hole{EARLIER}), b AS (SELECT * FROM hole719)
SELECT chain_id, cluster, missing_nonce, coalesce(b.highest_buffered, a.highest_buffered) AS highest_buffered,
 coalesce(b.reason, a.reason) AS reason, CAST(CASE WHEN a.cluster IS NULL THEN 2000 ELSE 1000 END AS BIGINT) AS observed_at,
 CAST(NULL AS BIGINT) AS resolved_at FROM a FULL JOIN b USING (chain_id, cluster, missing_nonce)""")
def hole_upsert(spark: SparkSession, sf: str) -> DataFrame:
    later = orderer.find_holes(_ordered_at(spark, sf, S.HEAD), TICK_NOW, 5, 1000 * S.BLOCK_SECONDS)
    return as_hex(control.record_holes(_first_holes(spark, sf), later, 2000))


@query(Q.HOLES + f""", a AS (SELECT * FROM hole{EARLIER}),
h AS (SELECT a.*, EXISTS (SELECT 1 FROM ins WHERE ins.cluster = a.cluster AND ins.chain_id = a.chain_id
  AND nonce = missing_nonce AND block_number <= 707) AS changed FROM a)
SELECT h.* EXCLUDE (changed), CAST(1000 AS BIGINT) AS observed_at, CAST(CASE WHEN changed THEN 3000 END AS BIGINT) AS resolved_at, changed FROM h""")
def hole_resolution(spark: SparkSession, sf: str) -> DataFrame:
    arrived = _sunk(spark, sf).where(F.col("block_number") <= S.HEAD - CONFIRMATIONS)
    return as_hex(control.resolve_holes(_first_holes(spark, sf), arrived, 3000))


@query(Q.HOLES + f""", a AS (SELECT * FROM hole{EARLIER}) SELECT * FROM a WHERE NOT EXISTS (
 SELECT 1 FROM ins WHERE ins.cluster = a.cluster AND ins.chain_id = a.chain_id AND nonce = missing_nonce AND block_number <= 707)""")
def open_holes(spark: SparkSession, sf: str) -> DataFrame:
    arrived = _sunk(spark, sf).where(F.col("block_number") <= S.HEAD - CONFIRMATIONS)
    resolved = control.resolve_holes(_first_holes(spark, sf), arrived, 3000)
    return as_hex(control.open_holes(resolved).select(
        "chain_id", "cluster", "missing_nonce", "highest_buffered", "reason"))


@query(Q.HOLES + f""", a AS (SELECT * FROM hole{EARLIER}) SELECT chain_id, cluster, missing_nonce FROM a WHERE EXISTS (
 SELECT 1 FROM lab WHERE lab.cluster = a.cluster AND lab.chain_id = a.chain_id AND lab.nonce = missing_nonce AND lab.outcome = 'Dispatched')""")
def closed_holes(spark: SparkSession, sf: str) -> DataFrame:
    closed = orderer.closed_holes(_first_holes(spark, sf), _ordered_at(spark, sf, S.HEAD))
    return as_hex(closed.select("chain_id", "cluster", "missing_nonce"))


@query(Q.ORDERED.format(initial="0", head="hd.head") + """SELECT row_id, chain_id, cluster, nonce FROM lab
WHERE outcome IN ('AwaitingPredecessor', 'NotFinal') AND block_number <= 500 + chain_id""")
def reorg_buffer_eviction(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(_blocks(spark, sf))
    waiting = orderer.order(_sunk(spark, sf), heads).where(
        F.col("outcome").isin(orderer.AWAITING, orderer.NOT_FINAL))
    ancestors = heads.select("chain_id", (F.col("chain_id") + 500).alias("ancestor"))
    return as_hex(orderer.evict_above(waiting, ancestors).select("row_id", "chain_id", "cluster", "nonce"))


@query(Q.SUNK + """SELECT row_id, chain_id, cluster, nonce FROM ins WHERE block_number <= 600 AND nonce >= 5
 AND (targets = '' OR contains(targets, printf('0x%064x', 3)))""")
def member_instruction_backlog(spark: SparkSession, sf: str) -> DataFrame:
    member = bytes(31) + bytes([3])
    return as_hex(control.member_backlog(_sunk(spark, sf), member, 5, 600).select(
        "row_id", "chain_id", "cluster", "nonce"))


@query(Q.SUNK + """SELECT row_id, cluster, nonce, NULLIF(t, '') AS member_id FROM ins, unnest(string_split(targets, ',')) AS u(t)""")
def instructions_by_audience(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(control.by_audience(_sunk(spark, sf)).select("row_id", "cluster", "nonce", "member_id"))


@query(Q.HOLES + f"""SELECT chain_id, cluster, CAST(0 AS INTEGER) AS part, 'hole' AS frame, missing_nonce AS nonce,
 '{{"missing_nonce":' || missing_nonce || ',"highest_buffered":' || highest_buffered || ',"reason":"' || reason || '","observed_at":1000}}' AS body
FROM hole{EARLIER} UNION ALL
SELECT chain_id, cluster, 1, 'instruction', nonce, '{{"instruction_id":"0x' || sha256('i' || row_id) || '","nonce":' || nonce ||
 ',"target_members":[' || CASE WHEN targets = '' THEN '' ELSE '"' || replace(targets, ',', '","') || '"' END || '],"expiry":' || expiry ||
 ',"salt":"' || printf('0x%064x', nonce) || '","ciphertext":"' || printf('0x%016x', row_id) || '","ciphertext_hash":"0x' || sha256('c' || row_id) ||
 '","block_number":' || block_number || ',"log_index":' || row_id || ',"tx_hash":"0x' || sha256('t' || row_id) || '"}}'
FROM ins WHERE nonce >= 20 AND block_number <= 600""")
def connect_feed(spark: SparkSession, sf: str) -> DataFrame:
    backlog = control.final_since(_sunk(spark, sf), 20, 600)
    return as_hex(control.connect_feed(_first_holes(spark, sf), backlog))


# --- feeds -----------------------------------------------------------------

@query(Q.EV + """SELECT event_id, chain_id, '{"cluster":"' || contract || '","kind":"' || kind || '","event_id":' || event_id ||
 ',"block_number":' || block_number || ',"log_index":' || log_index || '}' AS payload FROM ev""")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.change_feed(_events(spark, sf))


@query(Q.SUNK + """SELECT row_id AS event_id, chain_id, '{"cluster":"' || cluster || '","kind":"ControlInstructionBroadcast","row_id":' || row_id ||
 ',"event_id":' || row_id || ',"block_number":' || block_number || ',"log_index":' || row_id || '}' AS payload FROM ins""")
def control_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.control_feed(_sunk(spark, sf), "ControlInstructionBroadcast")


@query(Q.EV + "SELECT event_id, contract, kind FROM ev WHERE NOT removed AND event_id > 50 AND kind IN ('MemberRegistered', 'MemberRetired')")
def subscription_backlog(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.subscription(_events(spark, sf), since=50, kinds=["MemberRegistered", "MemberRetired"])
    return as_hex(jobs.each_once(S.redelivered(rows.select("event_id", "kind", *schemas.EVENT_KEY)))
                  .select("event_id", "contract", "kind"))


# --- summaries and audit ---------------------------------------------------

@query(Q.EV + """SELECT 'chain-' || chain_id AS shortname, chain_id, max(block_number) AS head_block,
 CAST(max(block_number) - 12 AS BIGINT) AS finalized_block, max(event_id) AS last_event_id FROM ev GROUP BY chain_id""")
def chain_summary(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf)
    chains = _heads(blocks).select(F.concat(F.lit("chain-"), F.col("chain_id").cast("string")).alias("shortname"), "chain_id")
    return health.chain_summary(chains, ingest.chain_state(blocks, CONFIRMATIONS), _events(spark, sf))


@query(Q.EV + """SELECT chain_id, count(*) AS events_ingested, count(*) FILTER (event_id % 50 = 0) AS events_deduped,
 count(DISTINCT block_number) FILTER (removed) AS blocks_replaced, max(block_number) AS head_block,
 CAST(max(block_number) - 12 AS BIGINT) AS finalized_block, CAST(1706745600 - max(block_ts) AS BIGINT) AS lag_seconds
FROM ev GROUP BY chain_id""")
def ingest_health(spark: SparkSession, sf: str) -> DataFrame:
    events, blocks = _events(spark, sf), _blocks(spark, sf)
    return health.ingest_health(S.redelivered(events), blocks, ingest.chain_state(blocks, CONFIRMATIONS),
                                reorg.orphan_blocks(events, blocks), now=1706745600)


@query(ORACLES["ingest_health"])
def stream_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health from what the batches counted: logs with every fiftieth twice under the blocks they name, then the headers."""
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    raw = _raw(spark, sf)
    again = F.col("event_id") % 50 == 0
    for number, batch in enumerate((live.inputs(raw), live.inputs(raw.where(again)), live.inputs(headers=_blocks(spark, sf)))):
        chain(batch, number)
    return chain.health(now=1706745600)


LEADER_DRIFT = f""", st AS ({Q.LEADER_AT.format(bound=EARLIER)}), rb AS ({Q.LEADER_AT.format(bound=AS_OF)})"""


def _stale_leaders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, sf)
    return views.LEADER.replay(events, EARLIER), views.LEADER.replay(events, AS_OF)


@query(Q.EV + LEADER_DRIFT + """SELECT coalesce(st.chain_id, rb.chain_id) AS chain_id, coalesce(st.contract, rb.contract) AS contract,
 CASE WHEN st.contract IS NULL THEN 'missing' WHEN rb.contract IS NULL THEN 'surplus' ELSE 'different' END AS drift
FROM st FULL JOIN rb ON st.chain_id = rb.chain_id AND st.contract = rb.contract
WHERE (st.member_id, st.epoch, st.claimed_block) IS DISTINCT FROM (rb.member_id, rb.epoch, rb.claimed_block)""")
def leader_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A leader table left at an earlier block against a rebuild."""
    stored, rebuilt = _stale_leaders(spark, sf)
    return as_hex(audit.drift(stored, rebuilt, views.CLUSTER).select(*views.CLUSTER, "drift"))


@query(Q.EV + LEADER_DRIFT + """SELECT *, 'stored' AS side FROM (SELECT * FROM st EXCEPT ALL SELECT * FROM rb) UNION ALL
SELECT *, 'rebuilt' FROM (SELECT * FROM rb EXCEPT ALL SELECT * FROM st)""")
def leader_row_diff(spark: SparkSession, sf: str) -> DataFrame:
    stored, rebuilt = _stale_leaders(spark, sf)
    return as_hex(audit.row_diff(stored, rebuilt))


@query(Q.EV + LEADER_DRIFT + """SELECT coalesce(st.chain_id, rb.chain_id) AS chain_id, coalesce(st.contract, rb.contract) AS contract,
 CASE WHEN st.contract IS NULL THEN 'missing' ELSE 'different' END AS drift
FROM st FULL JOIN rb ON st.chain_id = rb.chain_id AND st.contract = rb.contract
WHERE (st.member_id, st.epoch, st.claimed_block) IS DISTINCT FROM (rb.member_id, rb.epoch, rb.claimed_block)
 AND CAST('0x' || substr(md5(coalesce(st.contract, rb.contract)), 1, 8) AS BIGINT) % 4 = 0""")
def sampled_proof_check(spark: SparkSession, sf: str) -> DataFrame:
    """One answer in four checked against its proof events; the answers are stale."""
    stale, _ = _stale_leaders(spark, sf)
    wrong = audit.proof_check(stale, _events(spark, sf), views.LEADER, AS_OF, one_in=4)
    return as_hex(wrong.select(*views.CLUSTER, "drift"))


AS_OF_JSON = """'{"block_hash":"0x' || sha256('b' || 360) || '","block_number":360,"block_timestamp":1705363200,"finalized_block":' || (head - 12) || ',"safety":"head"}'"""


def _resolved(blocks: DataFrame) -> DataFrame:
    """Every chain read at the same explicit block."""
    requests = _heads(blocks).select(F.col("chain_id").alias("request_id"), "chain_id",
                                     F.lit(None).cast("string").alias("safety"),
                                     F.lit(AS_OF).cast("long").alias("as_of_block"))
    return asof.resolve(requests, ingest.chain_state(blocks, CONFIRMATIONS), blocks)


@query(Q.LEADER_CTE.format(bound=AS_OF) + f""", hd AS (SELECT chain_id, max(block_number) AS head FROM ev GROUP BY 1 HAVING bool_or(block_number = 360))
SELECT chain_id, contract, '0x' || sha256('{{"asOfBlock":360,"epoch":' || epoch || ',"memberId":"' || member_id || '"}}' || {AS_OF_JSON}) AS fingerprint
FROM leader JOIN hd USING (chain_id)""")
def leader_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    leaders = views.leader_for(S.clusters(spark, sf), views.LEADER.replay(_events(spark, sf), AS_OF), AS_OF)
    prints = audit.fingerprints(leaders, audit.leader_json(), _resolved(_blocks(spark, sf)))
    return as_hex(prints.select(*views.CLUSTER, "fingerprint"))


JSON_TEXT = "coalesce('\"' || {0} || '\"', 'null')"
JSON_INT = "coalesce(CAST({0} AS VARCHAR), 'null')"


@query(f"""WITH mem AS ({Q.MEMBERS.format(bound=AS_OF)}),
hd AS (SELECT CAST(user_id % 2 + 1 AS INTEGER) AS chain_id, max((day(ts) - 1) * 24 + hour(ts)) AS head FROM events GROUP BY 1 HAVING bool_or((day(ts) - 1) * 24 + hour(ts) = 360)),
fp AS (SELECT chain_id, contract, '0x' || sha256('{{"dnsLabel":' || {JSON_TEXT.format('dns_label')} || ',"instanceId":' || {JSON_TEXT.format('instance_id')}
 || ',"memberId":"' || member_id || '","passthrough":' || {JSON_TEXT.format('passthrough')} || ',"publicEndpoint":' || {JSON_TEXT.format('public_endpoint')}
 || ',"registeredAt":' || {JSON_INT.format('registered_at')} || ',"retiredAt":' || {JSON_INT.format('retired_at')} || '}}' || {AS_OF_JSON}) AS f
 FROM mem JOIN hd USING (chain_id))
SELECT chain_id, contract, CAST(sum(n) AS BIGINT) AS rows, '0x' || sha256(string_agg(b || d, '' ORDER BY b)) AS fingerprint FROM (
 SELECT chain_id, contract, substr(f, 3, 3) AS b, count(*) AS n, sha256(string_agg(f, '' ORDER BY f)) AS d FROM fp GROUP BY ALL) GROUP BY ALL""")
def member_set_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf)
    members = views.MEMBERS.replay(_events(spark, sf), AS_OF, blocks)
    prints = audit.fingerprints(members, audit.member_json(), _resolved(blocks))
    return as_hex(audit.combined_fingerprint(prints, views.CLUSTER))


@query(Q.LEADER_CTE.format(bound=AS_OF) + f""", lf AS (SELECT chain_id, contract, min(block_ts) AS d FROM ev
 WHERE kind = 'ClusterDestroyed' AND NOT removed AND block_number <= {AS_OF} GROUP BY ALL)
SELECT chain_id, contract, 'leader' AS endpoint, CAST(360 AS BIGINT) AS as_of_block, '' AS item,
 '{{"asOfBlock":360,"epoch":' || epoch || ',"memberId":"' || member_id || '"}}' AS payload, '0x' || sha256('b' || 360) AS as_of_hash
FROM leader WHERE chain_id = 2 UNION ALL
SELECT chain_id, contract, 'lifecycle', 360, '', '{{"destroyedAt":' || coalesce(CAST(d AS VARCHAR), 'null') || '}}', '0x' || sha256('b' || 360)
FROM leader LEFT JOIN lf USING (chain_id, contract) WHERE chain_id = 2""")
def as_of_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots to add where those of chain 1 are stored already."""
    events, blocks = _events(spark, sf), _blocks(spark, sf)
    endpoint = F.explode(F.array(F.lit("leader"), F.lit("lifecycle"))).alias("endpoint")
    requests = S.clusters(spark, sf).select("chain_id", "contract", endpoint, F.lit(AS_OF).cast("long").alias("as_of_block"))
    held = requests.where(F.col("chain_id") == 1).join(
        blocks.select("chain_id", F.col("number").alias("as_of_block"), F.col("hash").alias("as_of_hash")),
        ["chain_id", "as_of_block"])
    missing = audit.missing_snapshots(requests, held, blocks)
    return as_hex(audit.materialise(missing, events, blocks, AS_OF))


@query(Q.EV + MANY + """, w AS (SELECT DISTINCT chain_id, contract, as_of_block FROM req
 WHERE (chain_id, as_of_block) IN (SELECT chain_id, block_number FROM ev)),
l AS (SELECT w.*, member_id, k FROM w JOIN ev ON ev.chain_id = w.chain_id AND ev.contract = w.contract AND block_number <= as_of_block
 WHERE kind = 'LeaderClaimed' AND NOT removed QUALIFY row_number() OVER (PARTITION BY w.chain_id, w.contract, as_of_block ORDER BY k DESC, pos) = 1),
d AS (SELECT w.*, min(block_ts) AS d FROM w JOIN ev ON ev.chain_id = w.chain_id AND ev.contract = w.contract AND block_number <= as_of_block
 WHERE kind = 'ClusterDestroyed' AND NOT removed GROUP BY ALL)
SELECT chain_id, contract, 'leader' AS endpoint, as_of_block, '' AS item, '{"asOfBlock":' || as_of_block || ',"epoch":' || coalesce(k, 0) ||
 ',"memberId":"' || coalesce(member_id, '0x' || repeat('0', 64)) || '"}' AS payload, '0x' || sha256('b' || as_of_block) AS as_of_hash
FROM w LEFT JOIN l USING (chain_id, contract, as_of_block) UNION ALL
SELECT chain_id, contract, 'lifecycle', as_of_block, '', '{"destroyedAt":' || coalesce(CAST(d AS VARCHAR), 'null') || '}', '0x' || sha256('b' || as_of_block)
FROM w LEFT JOIN d USING (chain_id, contract, as_of_block)""")
def snapshots_of_many_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of hundreds of different blocks, made in one job."""
    events, blocks = _events(spark, sf), _blocks(spark, sf)
    endpoint = F.explode(F.array(F.lit("leader"), F.lit("lifecycle"))).alias("endpoint")
    requests = _many_blocks(spark, sf).select("chain_id", "contract", endpoint, "as_of_block")
    none = requests.where("false").withColumn("as_of_hash", F.lit(b""))
    return as_hex(audit.materialise_many(audit.missing_snapshots(requests, none, blocks), events, blocks, SAMPLE_BUCKET))


# --- streams ---------------------------------------------------------------

STREAM_PARTS = 3


def _feed(rows: DataFrame, order: str, folder: str, drain: Callable[[], None], last: int | None = None) -> None:
    """Rows appended to a growing table in arrival order, the job run after each append.

    Every run resumes from its checkpoint and takes the new files as one
    micro-batch, so what arrives when does not depend on file times. ``last``, the highest
    ``order``, is looked up where not given; for logs that would hash and encode them all once more.
    """
    if last is None:
        last = rows.agg(F.max(order)).first()[0] or 0
    part = F.floor(F.col(order) * STREAM_PARTS / (last + 1))
    for number in range(STREAM_PARTS):
        rows.where(part == number).write.mode("append").parquet(folder)
        drain()


def _last_id(events: DataFrame) -> int:
    return events.agg(F.max("event_id")).first()[0] or 0


def _ingest(spark: SparkSession, sf: str) -> live.LiveChain:
    """Redelivered raw logs in several micro-batches, the stored headers with the first."""
    watched = sized(S.clusters(spark, sf).withColumnRenamed("contract", "address"), "watched")
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    folder, headers, checkpoint = (work_dir(spark, n) for n in ("raw-logs", "headers", "chain-checkpoint"))
    S.stored_blocks(_blocks(spark, sf)).write.parquet(headers)

    def drain() -> None:
        stream = live.inputs(jobs.watched_only(logs.stream_logs(spark, folder), watched), logs.stream_headers(spark, headers))
        jobs.drain(stream, chain, checkpoint)

    _feed(S.redelivered(_raw(spark, sf)).drop("delivery"), "event_id", folder, drain, _last_id(S.table(spark, sf, "events")))
    return chain


STREAMED_EV = Q.EV.replace("block_number % 97 = 0 AS removed", "false AS removed")


@query(Q.EV + f"SELECT {EVENT_SQL} FROM ev")
def stream_event_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_ingest(spark, sf).log.read().select(*EVENT_COLUMNS))


@query(STREAMED_EV + Q.LEADER_AT.format(bound=S.HEAD))
def stream_leader_view(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_ingest(spark, sf).view("leader"))


@query(Q.MEMBERS.format(bound=S.HEAD).replace("block_number % 97 = 0 AS removed", "false AS removed"))
def stream_members_view(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_ingest(spark, sf).view("members"))


@query(Q.LIFECYCLE_ROWS.format(bound=S.HEAD).replace("block_number % 97 = 0 AS removed", "false AS removed"))
def stream_lifecycle_view(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_ingest(spark, sf).view("lifecycle"))


@query(Q.LEADER_ROWS.format(bound=S.HEAD))
def stream_leader_after_reorg(spark: SparkSession, sf: str) -> DataFrame:
    """View state once the canonical chain has shown orphaned blocks."""
    return as_hex(_reorganised(spark, sf).view("leader"))


@query(ORACLES["change_feed"])
def stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf).feed().drop("v")


@query(Q.BLOCKS + "SELECT * FROM blk")
def stream_block_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stored blocks first, then the canonical headers that replace the orphaned ones."""
    headers = _blocks(spark, sf)
    job = jobs.BlockJob(spark, work_dir(spark, "blocks"))
    arrivals = S.stored_blocks(headers).withColumn("round", F.lit(0)).unionByName(
        headers.withColumn("round", F.lit(1)))
    folder, checkpoint = work_dir(spark, "headers"), work_dir(spark, "headers-checkpoint")

    def drain() -> None:
        jobs.run(logs.stream_headers(spark, folder), job, checkpoint).awaitTermination()

    _feed(arrivals, "round", folder, drain)
    return as_hex(job.blocks())


def _deliver(spark: SparkSession, sf: str) -> jobs.OrderedDelivery:
    """Instructions and heads streamed in arrival order through ordered delivery."""
    rows = control.instructions(_events(spark, sf).where(~F.col("removed")))[0]
    sent = rows.withColumns({"row_type": F.lit(jobs.INSTRUCTION_ROW), "seq": F.col("row_id") * 2})
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.ORDERER_INPUT.fields
             if f.name not in ("row_type", "seq", "chain_id", "block_number")]
    # a row for each block, which every append would count again; the last row of all is one of them
    beats = sized(_events(spark, sf).groupBy("chain_id", "block_number").agg((F.max("event_id") * 2 + 1).alias("seq")), "beats")
    last = beats.agg(F.max("seq")).first()[0] or 0
    beats = beats.select(F.lit(jobs.HEAD_ROW).alias("row_type"), "seq", "chain_id", "block_number", *blank)
    columns = jobs.ORDERER_INPUT.fieldNames()
    job = jobs.OrderedDelivery(spark, work_dir(spark, "delivery"), clock=lambda: TICK_NOW)
    folder, checkpoint = work_dir(spark, "control-rows"), work_dir(spark, "delivery-checkpoint")

    def drain() -> None:
        jobs.drain(logs.stream_table(spark, folder, jobs.ORDERER_INPUT), job, checkpoint)

    _feed(sent.select(columns).unionByName(beats.select(columns)), "seq", folder, drain, last)
    return job


DELIVERED = Q.ORDERED.format(initial="0", head="hd.head")


@query(DELIVERED + "SELECT row_id, chain_id, cluster, nonce, block_number FROM lab WHERE outcome = 'Dispatched'")
def stream_ordered_delivery(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_deliver(spark, sf).dispatched().select(
        "row_id", "chain_id", "cluster", "nonce", "block_number"))


@query(DELIVERED + """SELECT row_id, cluster, nonce, NULLIF(t, '') AS member_id
FROM lab, unnest(string_split(targets, ',')) AS u(t) WHERE outcome = 'Dispatched'""")
def stream_member_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered instructions by audience, acks never among them."""
    return as_hex(control.by_audience(_deliver(spark, sf).dispatched()).select(
        "row_id", "cluster", "nonce", "member_id"))


@query(Q.EV + "SELECT event_id, chain_id, contract FROM ev WHERE event_id > 50")
def stream_subscription(spark: SparkSession, sf: str) -> DataFrame:
    """Backlog and tail of overlapping deliveries from an id on, each id once."""
    rows = S.redelivered(_events(spark, sf).select("event_id", "kind", "block_number", *schemas.EVENT_KEY))
    timed = rows.withColumns({"at": F.timestamp_seconds(S.block_ts(F.col("block_number"))),
                              "removed": F.lit(False)}).drop("delivery", "block_number")
    folder, out = work_dir(spark, "deliveries"), work_dir(spark, "subscription")
    checkpoint = work_dir(spark, "subscription-checkpoint")

    def drain() -> None:
        stream = logs.stream_table(spark, folder, timed.schema)
        kept = jobs.each_once(feeds.subscription(stream, since=50))
        kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start(out).awaitTermination()

    _feed(timed, "event_id", folder, drain)
    return as_hex(spark.read.schema(timed.schema).parquet(out).select("event_id", "chain_id", "contract"))


@query(Q.EV + "SELECT event_id, chain_id FROM ev")
def stream_late_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries from the newest to the oldest, each twice: every first one is late and counts."""
    rows = _events(spark, sf).select("event_id", *schemas.EVENT_KEY, (-F.col("event_id")).alias("turn"))
    folder, out = work_dir(spark, "late"), work_dir(spark, "late-once")
    checkpoint = work_dir(spark, "late-checkpoint")

    def drain() -> None:
        stream = logs.stream_table(spark, folder, rows.schema)
        jobs.each_once(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start(out).awaitTermination()

    last = rows.agg(F.max("event_id")).first()[0] or 0
    for low, high in ((last // 2, last), (0, last // 2), (0, last)):
        rows.where(F.col("event_id").between(low, high)).write.mode("append").parquet(folder)
        drain()
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "chain_id")


@query(Q.EV + """SELECT chain_id, contract, member_id, CAST(CAST(k AS HUGEINT) * CASE WHEN k % 3 = 0 THEN 100000000000000000000 ELSE 1 END AS VARCHAR) AS epoch,
 block_number AS claimed_block FROM ev WHERE kind = 'LeaderClaimed' AND NOT removed
 QUALIFY row_number() OVER (PARTITION BY chain_id, contract ORDER BY CAST(k AS HUGEINT) * CASE WHEN k % 3 = 0 THEN 100000000000000000000 ELSE 1 END DESC, pos) = 1""")
def leader_wide_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of which every third has an epoch far past 64 bits."""
    k = F.col("decoded.epoch")
    wide = F.when(k.cast("int") % 3 == 0, F.when(k == "0", k).otherwise(F.concat(k, F.lit("0" * 20)))).otherwise(k)
    events = _events(spark, sf).withColumn("decoded", F.struct(F.col("decoded.memberId").alias("memberId"), wide.alias("epoch")))
    return as_hex(views.wide_leaders(views.LEADER.partial(views.LEADER.events(events))))


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_chain_columns(S.table(spark, sf, "events")).where(F.col("kind") == "ControlInstructionBroadcast")


def _endless(sent: DataFrame) -> DataFrame:
    """Instructions as raw logs; those whose nonce, the last topic, ends in 0 never expire."""
    nonce = F.conv(F.hex(F.get("topics", F.lit(3))), 16, 10).cast("long")
    never = F.concat(F.substring("data", 1, 32), F.lit(bytes(24) + b"\xff" * 8), F.expr("substring(data, 65)"))
    return S.raw_logs(sent).withColumn("data", F.when(nonce % 10 == 0, never).otherwise(F.col("data")))


@query(STREAMED_EV + "SELECT event_id, chain_id, contract, kind, block_number FROM ev WHERE kind = 'ControlInstructionBroadcast' AND k % 10 = 0")
def stream_control_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions that never expire (2^64 - 1) are stored nowhere but in the rejects."""
    chain = live.LiveChain(spark, work_dir(spark, "chain"))
    events = _sent(spark, sf)
    folder, checkpoint = work_dir(spark, "raw-logs"), work_dir(spark, "ingest-checkpoint")

    def drain() -> None:
        jobs.drain(live.inputs(logs.stream_logs(spark, folder)), chain, checkpoint)

    _feed(_endless(events), "event_id", folder, drain, _last_id(events))
    return as_hex(chain.control_rejects().drop("v"))


def _late_headers(spark: SparkSession, sf: str) -> live.LiveChain:
    """All logs first, of which the last third of the heights has no header yet; then the headers."""
    headers, seen = S.stored_blocks(_blocks(spark, sf)), F.col("number") <= S.HEAD * 2 // 3
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    chain(live.inputs(_raw(spark, sf), headers.where(seen)), 0)
    chain(live.inputs(headers=headers.where(~seen)), 1)
    return chain


@query(ORACLES["stream_members_view"])
def stream_members_late_headers(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_late_headers(spark, sf).view("members"))


@query(ORACLES["stream_lifecycle_view"])
def stream_lifecycle_late_headers(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_late_headers(spark, sf).view("lifecycle"))


def _reorganised(spark: SparkSession, sf: str, **options) -> live.LiveChain:
    """Logs under the blocks that they name; then headers replace some blocks; then the orphans' logs come again."""
    raw = _raw(spark, sf)
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET, **options)
    chain(live.inputs(raw), 0)
    chain(live.inputs(headers=_blocks(spark, sf)), 1)
    chain(live.inputs(raw.where(F.col("block_number") % S.ORPHAN_EVERY == 0)), 2)
    return chain


@query(Q.SUNK + "SELECT row_id, chain_id, cluster, nonce, expiry, block_number FROM ins")
def stream_instructions_after_reorg(spark: SparkSession, sf: str) -> DataFrame:
    """Nonces that orphaned instructions held belong to canonical ones, and stay theirs when the orphans return."""
    chain = _reorganised(spark, sf)
    return as_hex(chain.state(chain.instructions).select("row_id", "chain_id", "cluster", "nonce", "expiry", "block_number"))


@query(Q.EV + "SELECT event_id, chain_id, removed FROM ev")
def stream_log_after_reorg(spark: SparkSession, sf: str) -> DataFrame:
    return _reorganised(spark, sf).events().select("event_id", "chain_id", "removed")


@query(Q.MEMBERS.format(bound=S.HEAD))
def stream_members_after_reorg(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_reorganised(spark, sf).view("members"))


@query(Q.EV + f"""SELECT chain_id, CAST(min(block_number) - 1 AS BIGINT) AS ancestor, max(head) AS head,
 count(DISTINCT block_number) AS blocks, count(*) AS removed_rows,
 CASE WHEN max(head) - (min(block_number) - 1) > {CONFIRMATIONS} THEN 'DEEPER_THAN_FINALITY' ELSE 'OK' END AS status
 FROM (SELECT *, max(block_number) OVER (PARTITION BY chain_id) AS head FROM ev) WHERE removed GROUP BY chain_id""")
def stream_rollbacks(spark: SparkSession, sf: str) -> DataFrame:
    """What the headers of :func:`_reorganised` took back, by chain."""
    return _reorganised(spark, sf).reorgs().drop("v")


LATE_FORK = S.ORPHAN_EVERY * 7
LATE_EV = Q.EV.replace("block_number % 97 = 0 AS removed", f"block_number = {LATE_FORK} AS removed")


def _late_fork(spark: SparkSession, sf: str) -> live.LiveChain:
    """A fork near the head after all else is settled, then its orphans' logs again; only the last buckets are folded anew."""
    raw, canonical = _raw(spark, sf), _blocks(spark, sf)
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    chain(live.inputs(raw, S.stored_blocks(canonical)), 0)
    chain(live.inputs(headers=canonical.where(F.col("number") >= LATE_FORK)), 1)
    chain(live.inputs(raw.where(F.col("block_number") == LATE_FORK)), 2)
    return chain


@query(LATE_EV + Q.LEADER_AT.format(bound=S.HEAD))
def stream_leader_after_late_fork(spark: SparkSession, sf: str) -> DataFrame:
    return as_hex(_late_fork(spark, sf).view("leader"))


@query(Q.SUNK.replace("block_number % 97 = 0 AS removed", f"block_number = {LATE_FORK} AS removed")
       + "SELECT row_id, chain_id, cluster, nonce, expiry, block_number FROM ins")
def stream_instructions_after_late_fork(spark: SparkSession, sf: str) -> DataFrame:
    chain = _late_fork(spark, sf)
    return as_hex(chain.state(chain.instructions).select("row_id", "chain_id", "cluster", "nonce", "expiry", "block_number"))


@query(LATE_EV + """SELECT event_id, chain_id, CAST(0 AS BIGINT) AS v FROM ev""")
def stream_feed_after_late_fork(spark: SparkSession, sf: str) -> DataFrame:
    """Every event has its envelope in the first batch; orphans that return have no other one."""
    return _late_fork(spark, sf).feed().select("event_id", "chain_id", F.col("v").cast("long").alias("v"))


@query(DELIVERED + "SELECT row_id, chain_id, cluster, nonce, block_number FROM lab WHERE outcome = 'Dispatched'")
def stream_delivery_through_reorg(spark: SparkSession, sf: str) -> DataFrame:
    """Logs, headers and ordered delivery in one job: what orphans left waiting goes before a head opens delivery."""
    out = jobs.OrderedDelivery(spark, work_dir(spark, "delivery"), clock=lambda: TICK_NOW)
    _reorganised(spark, sf, delivery=out)
    return as_hex(out.dispatched().select("row_id", "chain_id", "cluster", "nonce", "block_number"))


@query(Q.BLOCKS + f""", line AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY number) AS number,
 number AS was, count(*) OVER (PARTITION BY chain_id) AS n FROM blk)
SELECT chain_id, number, chain_id = 2 AND number > n // 2 AS rival FROM line""")
def fork_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Two branches with open tips in one batch. On chain 1 the rival is shorter, on chain 2 the trunk is."""
    order = Window.partitionBy("chain_id").orderBy("number")
    line = _blocks(spark, sf).select("chain_id", F.row_number().over(order).cast("long").alias("number"), "block_ts",
                                     F.count("*").over(Window.partitionBy("chain_id")).alias("n"))
    named = lambda tag, n: F.unhex(F.sha2(F.concat(F.lit(tag), F.col("chain_id"), F.lit(":"), n), 256))
    number, fork = F.col("number"), F.floor(F.col("n") / 2)
    trunk = line.where((F.col("chain_id") == 1) | (number <= F.col("n") - 5)).select(
        "chain_id", "number", named("b", number).alias("hash"), named("b", number - 1).alias("parent_hash"), "block_ts")
    rival = line.where((number > fork) & ((F.col("chain_id") == 2) | (number <= F.col("n") - 5))).select(
        "chain_id", "number", named("x", number).alias("hash"),
        F.when(number == fork + 1, named("b", number - 1)).otherwise(named("x", number - 1)).alias("parent_hash"), "block_ts")
    chosen = reorg.choose_forks(trunk.unionByName(rival))
    return chosen.select("chain_id", "number", (F.col("hash") == named("x", number)).alias("rival"))


def _factories(spark: SparkSession, sf: str) -> DataFrame:
    """The factories that minted a customer's cluster, configured from that block on."""
    return S.table(spark, sf, "customer").select(
        F.lit(1).alias("chain_id"), hexes.word(F.col("c_nationkey"), 20).alias("address"),
        (F.col("c_custkey") % 720).alias("from_block"))


@query("""SELECT 1 AS chain_id, printf('0x%040x', c_nationkey) AS address, 'factory' AS kind, CAST(NULL AS VARCHAR) AS parent,
 CAST(min(c_custkey % 720) AS BIGINT) AS from_block FROM customer GROUP BY c_nationkey""")
def watched_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Configured factories, each repeated for every cluster it minted, as watched rows."""
    return as_hex(registry.seed_factories(_factories(spark, sf)))


@query(Q.LEADER_CTE.format(bound=AS_OF) + f""", mem AS ({Q.MEMBERS.format(bound=AS_OF)})
SELECT chain_id, contract, 'leader' AS endpoint, CAST({AS_OF} AS BIGINT) AS as_of_block, '' AS item,
 '{{{{"asOfBlock":{AS_OF},"epoch":' || epoch || ',"memberId":"' || member_id || '"}}}}' AS payload FROM leader WHERE chain_id IN (SELECT user_id % 2 + 1 FROM events WHERE (day(ts) - 1) * 24 + hour(ts) = {AS_OF})
UNION ALL SELECT chain_id, contract, 'members', {AS_OF}, member_id, '{{{{"dnsLabel":' || {JSON_TEXT.format('dns_label')} || ',"instanceId":' || {JSON_TEXT.format('instance_id')}
 || ',"memberId":"' || member_id || '","passthrough":' || {JSON_TEXT.format('passthrough')} || ',"publicEndpoint":' || {JSON_TEXT.format('public_endpoint')}
 || ',"registeredAt":' || {JSON_INT.format('registered_at')} || ',"retiredAt":' || {JSON_INT.format('retired_at')} || '}}}}' FROM mem WHERE chain_id IN (SELECT user_id % 2 + 1 FROM events WHERE (day(ts) - 1) * 24 + hour(ts) = {AS_OF})""".replace("{{", "{").replace("}}", "}"))
def snapshots_put(spark: SparkSession, sf: str) -> DataFrame:
    """Leaders and member sets stored under replaced blocks give way to fresh ones; what is current stays."""
    events, blocks = _events(spark, sf), _blocks(spark, sf)
    endpoint = F.explode(F.array(F.lit("leader"), F.lit("members"))).alias("endpoint")
    requests = S.clusters(spark, sf).select("chain_id", "contract", endpoint, F.lit(AS_OF).cast("long").alias("as_of_block"))
    current = audit.materialise(audit.missing_snapshots(
        requests, requests.where("false").withColumn("as_of_hash", F.lit(b"")), blocks), events, blocks, AS_OF)
    stored = current.withColumns({
        "as_of_hash": F.when(F.col("chain_id") == 1, F.col("as_of_hash")).otherwise(F.lit(bytes(32))),
        "payload": F.when(F.col("chain_id") == 1, F.col("payload")).otherwise(F.lit("stale"))})
    stored = sized(stored, "stored-snapshots")
    fresh = audit.materialise(audit.missing_snapshots(requests, stored, blocks), events, blocks, AS_OF)
    return as_hex(audit.put_snapshots(stored, sized(fresh, "fresh-snapshots")).drop("as_of_hash"))


@query(Q.EV + """SELECT CAST(c_custkey AS BIGINT) AS event_id, printf('0x%040x', c_nationkey) AS contract, CAST(c_custkey % 720 AS BIGINT) AS block_number,
 'ClusterDeployed' AS kind FROM customer
UNION ALL SELECT event_id + 100000000, printf('0x%040x', user_id + 1000), block_number, kind FROM ev JOIN customer ON c_custkey = user_id
WHERE block_number >= c_custkey % 720""")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Cold start from seeded factories: their deployments first, then the minted clusters from their own blocks on."""
    emitted = S.with_chain_columns(S.table(spark, sf, "events")).withColumns(
        {"contract": hexes.word(F.col("user") + 1000, 20), "chain_id": F.lit(1), "event_id": F.col("event_id") + 100_000_000})
    raw = S.deployment_logs(spark, sf).unionByName(S.raw_logs(emitted))
    factories = registry.seed_factories(_factories(spark, sf))
    heads = spark.createDataFrame([(1, S.HEAD)], "chain_id int, head long")
    topics = [s.topic0 for s in decode.DEFAULT_SPECS]
    events, _, _ = cold_start(lambda plan: ingest.scan_plan(raw, plan, topics), factories,
                              spark.createDataFrame([], schemas.CURSOR), heads, work_dir(spark, "backfill"))
    return as_hex(events.select("event_id", "contract", "block_number", "kind"))


def _rpc_lines(raw: DataFrame) -> DataFrame:
    """Raw logs as a node's JSON lines."""
    number = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return raw.select(
        hexes.hex0x(F.col("address")).alias("address"), F.transform("topics", hexes.hex0x).alias("topics"),
        hexes.hex0x(F.col("data")).alias("data"), number(F.col("block_number")).alias("blockNumber"),
        hexes.hex0x(F.col("block_hash")).alias("blockHash"), hexes.hex0x(F.col("tx_hash")).alias("transactionHash"),
        number(F.col("log_index")).alias("logIndex"), F.lit(False).alias("removed"))


def _send(lines: DataFrame, folder: str) -> None:
    """Node lines into a folder, packed: as text they are some 700 bytes a log, mostly hex zeros."""
    lines.write.mode("append").json(folder, compression="gzip")


@query(Q.EV + "SELECT CAST(1 AS INTEGER) AS chain_id, contract AS address, block_number, log_index FROM ev")
def stream_rpc_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The log as JSON-RPC lines; retractions that a node sends for orphaned blocks are no logs."""
    raw = _raw(spark, sf)
    again = _rpc_lines(raw.where(F.col("block_number") % S.ORPHAN_EVERY == 0)).withColumn("removed", F.lit(True))
    folder, out, checkpoint = (work_dir(spark, n) for n in ("rpc", "rpc-logs", "rpc-checkpoint"))
    _send(_rpc_lines(raw).unionByName(again), folder)
    read = logs.stream_rpc_logs(spark, folder, 1)
    read.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return as_hex(spark.read.schema(read.schema).parquet(out).select("chain_id", "address", "block_number", "log_index"))


@query(Q.EV + """SELECT contract AS address, block_number, log_index, removed, false AS later FROM ev
UNION ALL SELECT contract, block_number, log_index, false, true FROM ev WHERE removed""")
def stream_rpc_fork(spark: SparkSession, sf: str) -> DataFrame:
    """A node's logs; then it takes some blocks back and sends their replacements' logs at the same positions.

    Both are stored. A replacement has an id beyond all that came before it, so readers who page by id get it.
    """
    raw, orphaned = _raw(spark, sf), F.col("block_number") % S.ORPHAN_EVERY == 0
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    folder, checkpoint = work_dir(spark, "rpc"), work_dir(spark, "rpc-checkpoint")

    def drain() -> None:
        jobs.drain(live.rpc_inputs(logs.stream_rpc_rows(spark, folder), 1), chain, checkpoint)

    _send(_rpc_lines(raw), folder)
    drain()
    first = chain.log.read().agg(F.max("event_id")).first()[0] or 0
    gone = _rpc_lines(raw.where(orphaned)).withColumn("removed", F.lit(True))
    canonical = F.unhex(F.sha2(F.concat(F.lit("b"), F.col("block_number").cast("string")), 256))
    _send(gone.unionByName(_rpc_lines(raw.where(orphaned).withColumn("block_hash", canonical))), folder)
    drain()
    return as_hex(chain.events().select(F.col("contract").alias("address"), "block_number", "log_index", "removed",
                                        (F.col("event_id") > first).alias("later")))


@query(Q.BLOCKS + "SELECT * FROM blk WHERE chain_id = 1")
def stream_rpc_headers(spark: SparkSession, sf: str) -> DataFrame:
    """A node's headers as JSON lines into the live chain's block table; heights known from a child alone have no time yet."""
    number = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    folder, checkpoint = work_dir(spark, "rpc-headers"), work_dir(spark, "rpc-headers-checkpoint")
    _blocks(spark, sf).where(F.col("chain_id") == 1).select(
        number(F.col("number")).alias("number"), hexes.hex0x(F.col("hash")).alias("hash"),
        hexes.hex0x(F.col("parent_hash")).alias("parentHash"), number(F.col("block_ts")).alias("timestamp")).write.json(folder)
    chain = live.LiveChain(spark, work_dir(spark, "chain"), bucket_blocks=SAMPLE_BUCKET)
    jobs.run(live.inputs(headers=logs.stream_rpc_headers(spark, folder, 1)), chain, checkpoint).awaitTermination()
    return as_hex(chain.blocks().where(F.col("block_ts") != 0))


@query(Q.EV + """SELECT event_id, printf('0x%040x', user_id + 1000) AS address, block_number FROM ev JOIN customer ON c_custkey = user_id
WHERE block_number >= c_custkey % 720""")
def stream_minted_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of clusters that are ahead of their deployments wait in the stream for them; both come twice."""
    emitted = S.raw_logs(S.with_chain_columns(S.table(spark, sf, "events")).withColumns(
        {"contract": hexes.word(F.col("user") + 1000, 20), "chain_id": F.lit(1)}))
    minting = S.deployment_logs(spark, sf)
    folder, factory, out, checkpoint = (work_dir(spark, n) for n in ("emitted", "minting", "minted-logs", "minted-checkpoint"))

    def drain() -> None:
        deployed = registry.deployments(decode.decode_logs(logs.stream_logs(spark, factory))[0]).select(
            "chain_id", F.col("decoded.diamond").alias("address"), F.col("block_number").alias("from_block"))
        found = jobs.logs_of_minted(jobs.each_once(logs.stream_logs(spark, folder).withColumn("contract", F.col("address"))).drop(
            "contract"), deployed, hold_blocks=100_000)
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()

    emitted.write.parquet(folder)
    minting.where("false").write.parquet(factory)
    drain()
    minting.write.mode("append").parquet(factory)
    drain()
    emitted.where(F.col("event_id") % 10 == 0).write.mode("append").parquet(folder)
    minting.where(F.col("event_id") % 10 == 0).write.mode("append").parquet(factory)
    drain()
    return as_hex(spark.read.schema(schemas.RAW_LOG).parquet(out).select("event_id", "address", "block_number"))
