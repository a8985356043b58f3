"""Small event sets and a sequential fold to compare the aggregates with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.operators import decode
from logtide.operators.decode import payload_type

CHAIN = 8453
CLUSTER = bytes.fromhex("11" * 20)

EVENT = (
    "event_id long, chain_id int, contract binary, block_number long, block_hash binary, log_index long, "
    f"tx_hash binary, kind string, decoded {payload_type()}, removed boolean")
FIELDS = [f.split(":")[0] for f in payload_type()[7:-1].replace("decimal(20,0)", "decimal").split(",")]


def m(first: int) -> bytes:
    return bytes([first]) + bytes(31)


def a(first: int) -> bytes:
    return bytes([first]) + bytes(19)


def event(block: int, kind: str, log_index: int = 0, contract: bytes = CLUSTER, removed: bool = False,
          event_id: int | None = None, chain_id: int = CHAIN, block_hash: bytes | None = None, **payload):
    return {
        "event_id": block * 1000 + log_index if event_id is None else event_id, "chain_id": chain_id,
        "contract": contract, "block_number": block,
        "block_hash": block_hash or block.to_bytes(32, "big"), "log_index": log_index,
        "tx_hash": bytes(32), "kind": kind,
        "decoded": tuple(payload.get(f) for f in FIELDS), "removed": removed}


def claim(block, member, epoch, log_index=0, **kw):
    return event(block, "LeaderClaimed", log_index, memberId=member, epoch=str(epoch), endpoint=b"", **kw)


def reg(block, member, label="n", log_index=0, instance=1, **kw):
    return event(block, "MemberRegistered", log_index, memberId=member, instanceId=a(instance),
                 passthrough=a(instance + 1), dnsLabel=label, **kw)


def moved(block, member, text=b"https://x", log_index=0, **kw):
    return event(block, "PublicEndpointUpdated", log_index, memberId=member, publicEndpoint=text, **kw)


def retire(block, member, log_index=0, **kw):
    return event(block, "MemberRetired", log_index, memberId=member, timestamp="0", **kw)


def destroy(block, log_index=0, **kw):
    return event(block, "ClusterDestroyed", log_index, timestamp="0", **kw)


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in EVENT.split(f", decoded {payload_type()}")[0].split(",")]
    names += ["decoded", "removed"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT)


def block_frame(spark: SparkSession, times: dict[int, int], chain_id: int = CHAIN) -> DataFrame:
    rows = [(chain_id, n, n.to_bytes(32, "big"), (n - 1 if n else 0).to_bytes(32, "big"), ts)
            for n, ts in times.items()]
    return spark.createDataFrame(
        rows, "chain_id int, number long, hash binary, parent_hash binary, block_ts long")


def random_events(seed: int, clusters: int = 12, count: int = 400) -> list[dict]:
    """Shuffled events with ties, early retirements and rolled-back rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        where = {"contract": a(rng.randrange(clusters)), "log_index": i, "removed": rng.random() < 0.1}
        block, member = rng.randrange(1, 40), m(rng.randrange(5))
        kind = rng.choice(["claim", "reg", "moved", "retire", "destroy"])
        if kind == "claim":
            rows.append(claim(block, member, rng.randrange(6), **where))
        elif kind == "reg":
            rows.append(reg(block, member, f"n{i}", instance=rng.randrange(9), **where))
        elif kind == "moved":
            rows.append(moved(block, member, rng.choice([b"https://a", b"\xff\xfe", b""]), **where))
        elif kind == "retire":
            rows.append(retire(block, member, **where))
        elif rng.random() < 0.2:
            rows.append(destroy(block, **where))
    rng.shuffle(rows)
    return rows


def fold(rows: list[dict], times: dict[int, int], as_of: int):
    """Leaders, members and ends by reading the events one by one in position order."""
    leaders, members, ended = {}, {}, {}
    index = {name: i for i, name in enumerate(FIELDS)}
    for r in sorted(rows, key=lambda r: (r["block_number"], r["log_index"])):
        if r["removed"] or r["block_number"] > as_of:
            continue
        get = lambda f: r["decoded"][index[f]]
        cluster, ts = r["contract"], times.get(r["block_number"])
        if r["kind"] == "LeaderClaimed":
            best = leaders.get(cluster)
            if best is None or int(get("epoch")) > best[1]:
                leaders[cluster] = (get("memberId"), int(get("epoch")))
        if ts is None:
            continue
        if r["kind"] == "MemberRegistered":
            row = members.setdefault((cluster, get("memberId")), [None] * 6)
            row[0:3] = [get("instanceId"), get("passthrough"), get("dnsLabel")]
            row[4] = ts
        elif r["kind"] == "PublicEndpointUpdated":
            raw = get("publicEndpoint")
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = "0x" + raw.hex()
            members.setdefault((cluster, get("memberId")), [None] * 6)[3] = text
        elif r["kind"] == "MemberRetired" and (cluster, get("memberId")) in members:
            members[(cluster, get("memberId"))][5] = ts
        elif r["kind"] == "ClusterDestroyed":
            ended.setdefault(cluster, ts)
    return leaders, members, ended


def raw_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(topics, data) pairs as raw logs."""
    from logtide.schemas import RAW_LOG
    return spark.createDataFrame(
        [(i, CHAIN, CLUSTER, topics, data, 100 + i, bytes(32), bytes(32), i)
         for i, (topics, data) in enumerate(rows)], RAW_LOG)


def topic0(kind: str) -> bytes:
    return next(bytes.fromhex(s.topic0) for s in decode.DEFAULT_SPECS if s.kind == kind)


def w(value: int) -> bytes:
    return value.to_bytes(32, "big")


def tail(raw: bytes) -> bytes:
    return w(len(raw)) + raw + bytes(-len(raw) % 32)


def decoded_json(events: DataFrame) -> list:
    import json
    rows = events.select("event_id", "kind", decode.payload_json(F.col("kind"), F.col("decoded")).alias("j"))
    return [(r["kind"], json.loads(r["j"]) if r["j"] else None) for r in rows.orderBy("event_id").collect()]
