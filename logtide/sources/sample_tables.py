"""The TPC-H-like sample tables read as chain data.

``events`` become contract events (one chain per user parity, one block per
hour), ``nation``/``customer`` factories and their clusters, ``lineitem``
acknowledgements. Everything is a row-wise expression over the source table;
nothing here shuffles but the distinct block list, and small tables to use all cores.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtide.functions.hexes import ZERO32, word
from logtide.operators.decode import DEFAULT_SPECS, SPARK_TYPES, computed, payload_fields
from logtide.schemas import RAW_LOG

GENESIS_TS = 1704067200
BLOCK_SECONDS = 3600
ORPHAN_EVERY = 97
HEAD = 719
TOPICS = {s.kind: bytes.fromhex(s.topic0) for s in DEFAULT_SPECS}


#: Tables on which every row costs some hashing here, with their keys.
SPREAD = {"events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"]}
#: Of ``events`` for one task; 100,000 rows are 65 MB or so as raw logs in memory, and 0.7 to 2 MB in a file.
BYTES_A_TASK, ROWS_A_TASK = 2_000_000, 100_000
#: Rows of a file with no more than this for each core are not counted.
FEW_BYTES = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; one in fewer splits than there are cores is dealt to all of them by its key.

    ``events`` is dealt at any size, to tasks in number as its bytes or its rows, whichever are more. These grow thirty- to
    ninetyfold as logs, by how well the file is packed, and splits do not bound them: a row group of a million rows
    lies in one split whole, whatever the others hold. The count reads footers only.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name == "events":
        size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        counted = rows.count() if size > cores * FEW_BYTES else 0
        return rows.repartition(max(cores, -(-size // BYTES_A_TASK), -(-counted // ROWS_A_TASK)), *SPREAD[name])
    if name in SPREAD and rows._jdf.rdd().getNumPartitions() < cores:
        return rows.repartition(cores, *SPREAD[name])
    return rows


def _hash(tag: str, number: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(tag), number.cast("string")), 256))


def block_ts(block_number: Column) -> Column:
    return F.lit(GENESIS_TS) + block_number * BLOCK_SECONDS


def with_chain_columns(events: DataFrame) -> DataFrame:
    """Sample events (batch or stream) with chain columns and the small integers payloads use."""
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "purchase", "LeaderClaimed")
        .when(F.col("event_type") == "signup", "MemberRegistered")
        .when(F.col("event_type") == "view", "PublicEndpointUpdated")
        .when(F.col("event_type") == "click", "ControlInstructionBroadcast")
        .when(k >= 95, "ClusterDestroyed").otherwise("MemberRetired")
    )
    number = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long")
    # the stored hash differs from the canonical one on some blocks: those are orphans
    stored_tag = F.when(F.col("block_number") % ORPHAN_EVERY == 0, F.lit("x")).otherwise(F.lit("b"))
    stored_hash = F.unhex(F.sha2(F.concat(stored_tag, F.col("block_number").cast("string")), 256))
    return (
        events.select("event_id", user.alias("user"), (user % 2 + 1).cast("int").alias("chain_id"),
                      word(user, 20).alias("contract"), number.alias("block_number"),
                      F.col("event_id").alias("log_index"), kind.alias("kind"), k.alias("k"))
        .withColumns({
            # a claimant is independent of its epoch, so equal epochs meet different members
            "m": F.when(F.col("kind") == "LeaderClaimed", F.col("event_id") % 8).otherwise(F.col("k") % 8),
            "block_hash": stored_hash, "tx_hash": _hash("t", F.col("event_id")),
            "removed": F.col("block_number") % ORPHAN_EVERY == 0})
    )


def _payload_values() -> dict[str, dict[str, Column]]:
    """Typed payload fields per kind."""
    k = F.col("k")
    member = word(F.col("m"))
    endpoint = F.encode(F.concat(F.lit("https://m"), k.cast("string"), F.lit(".example")), "UTF-8")
    ts = block_ts(F.col("block_number"))
    return {
        "LeaderClaimed": {"memberId": member, "epoch": k.cast("string"), "endpoint": endpoint},
        "MemberRegistered": {
            "memberId": member, "instanceId": word(k + 1, 20), "passthrough": word(k + 2, 20),
            "dnsLabel": F.concat(F.lit("node-"), k.cast("string"))},
        "PublicEndpointUpdated": {"memberId": member, "publicEndpoint": endpoint},
        "MemberRetired": {"memberId": member, "timestamp": ts.cast("string")},
        "ClusterDestroyed": {"timestamp": ts.cast("string")},
        "ControlInstructionBroadcast": {
            "instructionId": _hash("i", F.col("event_id")), "clusterId": word(F.col("user")),
            "nonce": k.cast("decimal(20,0)"),
            "targetMembers": F.when(k % 3 == 0, F.array().cast("array<binary>")).otherwise(
                F.array(member, word((k + 1) % 8))),
            "expiry": (ts + k * 3600).cast("decimal(20,0)"), "salt": word(k),
            "ciphertextHash": _hash("c", F.col("event_id")), "ciphertext": word(F.col("event_id"), 8)},
    }


@lru_cache(maxsize=1)
def _payload_column() -> Column:
    values = _payload_values()
    columns = []
    for name, abi in payload_fields(DEFAULT_SPECS).items():
        users = [(kind, fields[name]) for kind, fields in values.items() if name in fields]
        column = F.lit(None).cast(SPARK_TYPES[abi])
        if users:
            column = F.when(F.col("kind") == users[0][0], users[0][1])
            for kind, value in users[1:]:
                column = column.when(F.col("kind") == kind, value)
        columns.append(column.alias(name))
    return F.struct(*columns)


def with_payload(rows: DataFrame) -> DataFrame:
    """Chain columns with the typed payload a decoder would give."""
    return rows.withColumn("decoded", _payload_column()).drop("k", "m", "user")


def contract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded events."""
    return with_payload(with_chain_columns(table(spark, sf_dir, "events")))


def redelivered(events: DataFrame) -> DataFrame:
    """Every event once, and each fiftieth a second time."""
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("delivery", F.explode(copies))


def _pad(raw: Column) -> Column:
    """Bytes padded with zeros to whole words."""
    size = F.octet_length(raw)
    return F.concat(raw, F.substring(F.lit(ZERO32), 1, (32 - size % 32) % 32))


def _tail(raw: Column) -> Column:
    return F.concat(word(F.octet_length(raw)), _pad(raw))


def raw_logs(rows: DataFrame) -> DataFrame:
    """Chain columns as undecoded logs: topics and ABI-encoded data."""
    k = F.col("k")
    values = _payload_values()
    claim, joined, moved, sent = (values[n] for n in (
        "LeaderClaimed", "MemberRegistered", "PublicEndpointUpdated", "ControlInstructionBroadcast"))
    number = lambda n: word(F.lit(n))
    ts = word(block_ts(F.col("block_number")))
    targets = sent["targetMembers"]
    listed = F.when(F.size(targets) == 0, number(0)).otherwise(
        F.concat(number(2), F.get(targets, F.lit(0)), F.get(targets, F.lit(1))))
    topic = {kind: F.lit(value) for kind, value in TOPICS.items()}
    layout = {
        "LeaderClaimed": ([claim["memberId"], word(k)], F.concat(number(32), _tail(claim["endpoint"]))),
        "MemberRegistered": (
            [joined["memberId"], word(k + 1), word(k + 2)],
            F.concat(number(32), _tail(F.encode(joined["dnsLabel"], "UTF-8")))),
        "PublicEndpointUpdated": ([moved["memberId"]], F.concat(number(32), _tail(moved["publicEndpoint"]))),
        "MemberRetired": ([word(k % 8)], ts),
        "ClusterDestroyed": ([], ts),
        "ControlInstructionBroadcast": (
            [sent["instructionId"], sent["clusterId"], word(k)],
            F.concat(number(160), word(sent["expiry"].cast("long")), sent["salt"], sent["ciphertextHash"],
                     word(F.octet_length(listed) + 160), listed, _tail(sent["ciphertext"]))),
    }
    topics = data = None
    for kind, (rest, body) in layout.items():
        here = F.col("kind") == kind
        listed_topics = F.array(topic[kind], *rest)
        topics = F.when(here, listed_topics) if topics is None else topics.when(here, listed_topics)
        data = F.when(here, body) if data is None else data.when(here, body)
    return _as_source(rows.withColumn("address", F.col("contract")), topics, data)


def _as_source(rows: DataFrame, topics: Column, data: Column) -> DataFrame:
    """Raw log columns with topics and data computed once per row, as a stored log has them."""
    return computed(rows, topics.alias("topics"), data.alias("data")).select(RAW_LOG.fieldNames())


def deployment_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the factories' deployment logs."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    block = key % 720
    rows = customer.select(
        key.alias("event_id"), F.lit(1).alias("chain_id"), word(F.col("c_nationkey"), 20).alias("address"),
        block.alias("block_number"), _hash("b", block).alias("block_hash"),
        _hash("d", key).alias("tx_hash"), key.alias("log_index"), "c_custkey", "c_nationkey")
    topics = F.array(F.lit(TOPICS["ClusterDeployed"]), word(key + 1000), word(F.col("c_nationkey")), word(key))
    return _as_source(rows, topics, F.lit(b""))


def ack_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as acknowledgement logs; (order, line) pairs repeat, so keys collide.

    The table has no arrival id of its own, so one is taken from a hash of the row.
    """
    items = table(spark, sf_dir, "lineitem")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"),
             F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag", "l_linestatus"]
    number = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = computed(
        items,
        F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long").alias("event_id"),
        number.alias("block_number"), ack_status().alias("status"),
        word(F.col("l_orderkey")).alias("order_word"), word(F.col("l_suppkey")).alias("supplier_word"))
    status = F.col("status")
    summary = F.encode(F.concat(F.lit("s"), status.cast("string")), "UTF-8")
    pointer = F.when(status == 1, F.lit(ZERO32)).otherwise(word(F.col("l_partkey") + 1))
    body = F.when(status == 1, F.lit(ZERO32)).otherwise(
        F.concat(F.lit(bytes(31) + b"\x02"), summary, F.lit(bytes(30))))
    topics = F.array(F.lit(TOPICS["ControlAck"]), word(F.col("l_partkey")), F.col("order_word"),
                     F.col("supplier_word"))
    data = F.concat(word(status), word(F.col("l_linenumber")), pointer, F.lit(bytes(31) + b"\x80"), body)
    rows = rows.withColumns({
        "chain_id": F.lit(1), "address": F.substring("order_word", 13, 20),
        "block_hash": _hash("b", F.col("block_number")), "tx_hash": _hash("a", F.col("event_id")),
        "log_index": F.lit(0).cast("long")})
    return _as_source(rows, topics, data)


def ack_status() -> Column:
    """Status 1..6 from return flag and line status."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return (flag * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0) + 1).cast("int")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical blocks: one per chain and hour in which anything happened."""
    source = table(spark, sf_dir, "events")
    number = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long")
    heights = source.select((F.col("user_id") % 2 + 1).cast("int").alias("chain_id"),
                            number.alias("number")).distinct()
    return heights.select(
        "chain_id", "number", _hash("b", F.col("number")).alias("hash"),
        _hash("b", F.col("number") - 1).alias("parent_hash"), block_ts(F.col("number")).alias("block_ts"))


def stored_blocks(canonical: DataFrame) -> DataFrame:
    """The local block table: as canonical, but for the orphaned heights."""
    tag = lambda number: F.when(number % ORPHAN_EVERY == 0, F.lit("x")).otherwise(F.lit("b"))
    number, parent = F.col("number"), F.col("number") - 1
    return canonical.select(
        "chain_id", "number", F.unhex(F.sha2(F.concat(tag(number), number.cast("string")), 256)).alias("hash"),
        F.unhex(F.sha2(F.concat(tag(parent), parent.cast("string")), 256)).alias("parent_hash"), "block_ts")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract of the sample, whether or not it emitted what a view needs."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2 + 1).cast("int").alias("chain_id"), word(F.col("user_id"), 20).alias("contract")
    ).distinct()


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factories from ``nation`` and clusters from ``customer``."""
    factories = table(spark, sf_dir, "nation").select(
        F.lit(1).alias("chain_id"), word(F.col("n_nationkey"), 20).alias("address"),
        F.lit("factory").alias("kind"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("from_block"))
    minted = table(spark, sf_dir, "customer").select(
        F.lit(1).alias("chain_id"), word(F.col("c_custkey") + 1000, 20).alias("address"),
        F.lit("cluster_diamond").alias("kind"), word(F.col("c_nationkey"), 20).alias("parent"),
        (F.col("c_custkey") % 720).alias("from_block"))
    return factories.unionByName(minted)
