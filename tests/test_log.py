from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logtide import schemas
from logtide.functions import canonical as C
from logtide.operators import audit, feeds, health, ingest, pages, registry, reorg, views
from logtide.plans.backfill import backfill
from logtide.plans.reads import ChainReader, NotFound
from logtide.session import scratch, sized
from logtide.sources import logs
from logtide.sources.tables import EventLog
from logtide.streaming import jobs
from tests.fixtures import (
    CHAIN, CLUSTER, a, block_frame, claim, destroy, event, frame, m, moved, raw_log, reg, retire, tail, topic0, w,
)

FACTORIES = "chain_id int, address binary, from_block long"
BLOCK = "chain_id int, number long, hash binary, parent_hash binary, block_ts long"


def headers(spark, rows, seq=None):
    """Rows of (number, hash byte, parent byte, ts[, seq])."""
    schema = BLOCK + (", seq long" if seq else "")
    return spark.createDataFrame([(CHAIN, n, m(h), m(p), ts, *more) for n, h, p, ts, *more in rows], schema)


def test_append_is_idempotent_per_block_hash(spark):
    rows = [claim(1, m(1), 1, event_id=5), claim(1, m(1), 1, event_id=3),
            claim(1, m(1), 1, event_id=9, block_hash=m(7))]
    events = frame(spark, rows)
    kept = ingest.append_events(events)
    assert sorted(r["event_id"] for r in kept.collect()) == [3, 9]
    assert ingest.append_events(events, kept).isEmpty()
    counts = ingest.count_duplicates(events).first()
    assert (counts["received"], counts["ingested"], counts["duplicates"]) == (3, 2, 1)


def test_block_upsert_reports_replaced_hash_and_keeps_header_values(spark):
    stored = headers(spark, [(1, 10, 9, 100), (2, 20, 10, 200), (3, 30, 20, 300)])
    incoming = headers(spark, [(1, 10, 0, 0, 1), (2, 21, 10, 201, 2), (3, 31, 0, 0, 3), (4, 40, 0, 0, 4), (4, 40, 31, 400, 5)], seq=True)
    got = {r["number"]: (bytes(r["hash"])[0], bytes(r["parent_hash"])[0], r["block_ts"],
                         bytes(r["previous_hash"])[0] if r["previous_hash"] else None)
           for r in ingest.upsert_blocks(stored, incoming).collect()}
    assert got == {1: (10, 9, 100, None), 2: (21, 10, 201, 20), 3: (31, 0, 0, 30), 4: (40, 31, 400, None)}


def test_cursors_plan_and_chunks(spark):
    watched = spark.createDataFrame(
        [(CHAIN, a(1), "factory", None, 100), (CHAIN, a(2), "cluster_diamond", a(1), 50),
         (CHAIN, a(3), "cluster_diamond", a(1), 9000)], schemas.WATCHED)
    cursors = spark.createDataFrame([(CHAIN, a(1), 300)], schemas.CURSOR)
    heads = spark.createDataFrame([(CHAIN, 5000)], "chain_id int, head long")
    plan = ingest.plan_backfill(watched, cursors, heads)
    assert [(bytes(r["contract"]), r["from_block"]) for r in plan.collect()] == [(a(2), 50), (a(1), 300)]
    chunks = ingest.split_chunks(plan).where(F.col("contract") == F.lit(a(1))).orderBy("chunk_start").collect()
    assert [(r["chunk_start"], r["chunk_end"]) for r in chunks] == [(300, 2299), (2300, 4299), (4300, 5000)]
    moved_on = ingest.advance_cursors(cursors, spark.createDataFrame(
        [(CHAIN, a(1), 200), (CHAIN, a(2), 7)], schemas.CURSOR))
    assert {bytes(r["contract"]): r["next_block"] for r in moved_on.collect()} == {a(1): 300, a(2): 7}


def test_chain_state_has_no_finalized_block_on_a_short_chain(spark):
    short = headers(spark, [(n, n, n, n) for n in range(5)])
    assert tuple(ingest.chain_state(short, 12).first()) == (CHAIN, 4, None)
    assert tuple(ingest.chain_state(short, 4).first()) == (CHAIN, 4, 0)


def test_reorg_detection(spark):
    stored = headers(spark, [(1, 1, 0, 1), (2, 2, 1, 2), (3, 3, 2, 3)])
    seen = headers(spark, [(3, 3, 2, 3), (4, 4, 3, 4), (2, 9, 1, 2), (4, 5, 8, 4)])
    found = {(r["number"], r["parent_mismatch"], r["hash_changed"]) for r in reorg.detect(
        seen.where("number <> 4 or hash <> X'%s'" % m(5).hex()), stored).collect()}
    assert found == {(2, False, True)}
    clash = reorg.detect(headers(spark, [(4, 5, 8, 4)]), stored).first()
    assert (clash["parent_mismatch"], clash["hash_changed"]) == (True, False)


@pytest.mark.parametrize("local, truth, head, expected", [
    ({9: 9, 10: 1}, {9: 9, 10: 10}, 10, (9, "OK")),
    ({10: 10}, {10: 10}, 10, (10, "OK")),
    ({10: 1, 8: 1}, {10: 10, 9: 9, 8: 8}, 10, (9, "OK")),
    ({n: 1 for n in range(7, 11)}, {n: 2 for n in range(0, 11)}, 10, (None, "DEEPER_THAN_FINALITY")),
    ({n: 1 for n in range(0, 3)}, {n: 2 for n in range(0, 3)}, 2, (0, "OK")),
    ({n: 1 for n in range(0, 4)}, {n: 2 for n in range(0, 4)}, 3, (None, "DEEPER_THAN_FINALITY")),
    ({10: 1, 9: 9}, {9: 9}, 10, (None, "NO_CANONICAL_BLOCK")),
])
def test_common_ancestor(spark, local, truth, head, expected):
    frames = [headers(spark, [(n, h, 0, 0) for n, h in side.items()]) for side in (local, truth)]
    heads = spark.createDataFrame([(CHAIN, head)], "chain_id int, head long")
    row = reorg.common_ancestor(heads, *frames, finality_depth=3).first()
    assert (row["ancestor"], row["status"]) == expected


def test_removed_follows_the_canonical_chain_and_rollback_counts(spark):
    events = frame(spark, [claim(1, m(1), 1), claim(2, m(1), 2, block_hash=m(9)), claim(3, m(1), 3)])
    truth = block_frame(spark, {1: 1, 2: 2})
    orphans = reorg.orphan_blocks(events, truth)
    got = {r["block_number"]: r["removed"] for r in reorg.mark_removed(events, orphans).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert reorg.survivors(events, orphans).count() == 2
    rolled = reorg.roll_back(events, spark.createDataFrame([(CHAIN, 1)], "chain_id int, ancestor long"))
    assert reorg.rollback_counts(rolled).first()["removed_rows"] == 2
    again = reorg.roll_back(rolled.drop("flipped"), spark.createDataFrame([(CHAIN, 1)], "chain_id int, ancestor long"))
    assert reorg.rollback_counts(again).first()["removed_rows"] == 0


def test_registry(spark):
    deploy = lambda block, address, factory, **kw: event(
        block, "ClusterDeployed", contract=factory, diamond=address, deployer=a(1), salt=m(1), **kw)
    events = frame(spark, [deploy(9, a(5), a(2)), deploy(4, a(5), a(3)), deploy(6, a(6), a(2)),
                           deploy(5, a(7), a(2), removed=True), deploy(5, b"\x01", a(2), log_index=1)])
    seeded = registry.seed_factories(spark.createDataFrame([(CHAIN, a(2), 0), (CHAIN, a(3), 0), (CHAIN, a(3), 5)], FACTORIES))
    watched = registry.rediscover(seeded, events)
    clusters = {bytes(r["address"]): (bytes(r["factory"]), r["from_block"]) for r in registry.clusters_of(watched).collect()}
    assert clusters == {a(5): (a(3), 4), a(6): (a(2), 6)}
    again = registry.register(watched, seeded.withColumn("from_block", F.lit(99).cast("long")))
    assert again.exceptAll(watched).isEmpty() and again.count() == 4
    probes = spark.createDataFrame([(CHAIN, a(3), a(5)), (CHAIN, a(2), a(5)), (CHAIN, a(9), a(2))],
                                   "chain_id int, factory binary, address binary")
    found = {(bytes(r["factory"]), bytes(r["address"])): r["contains"] for r in registry.contains(probes, watched).collect()}
    assert found == {(a(3), a(5)): True, (a(2), a(5)): False, (a(9), a(2)): False}
    assert [bytes(r["address"]) for r in registry.listing(watched).collect()] == [a(2), a(3), a(5), a(6)]


def test_kinds_and_limits():
    assert pages.parse_kinds(" A, ,B,") == ["A", "B"]
    assert pages.parse_kinds(None) == pages.parse_kinds(" , ") == []
    assert [pages.clamp_limit(n) for n in (None, 0, -5, 7, 5000)] == [100, 1, 1, 7, 1000]


def test_pages(spark):
    rows = [claim(b, m(1), b, event_id=b) for b in range(1, 9)] + [retire(9, m(1), event_id=9, removed=True)]
    events = frame(spark, rows)
    page = pages.event_page(events, CLUSTER, CHAIN, since=2, limit=3, as_of=7)
    assert [r["event_id"] for r in page.collect()] == [3, 4, 5]
    assert pages.next_since(page).first()["next_since"] == 5
    assert pages.next_since(pages.event_page(events, since=50)).first()["next_since"] is None
    assert pages.event_page(events, kinds=["MemberRetired"]).isEmpty()
    assert pages.event_by_id(events, 9).first()["removed"]
    unknown = frame(spark, [event(1, None)])
    assert pages.event_page(unknown).count() == 1 and pages.event_page(unknown, kinds=["LeaderClaimed"]).isEmpty()
    assert pages.event_pages(events, limit=2).count() == 2


def test_envelopes(spark):
    rows = frame(spark, [claim(5, m(1), 1, event_id=7), event(6, None, event_id=8)])
    got = [r["payload"] for r in feeds.change_feed(rows).orderBy("event_id").collect()]
    cluster = "0x" + CLUSTER.hex()
    assert got == [
        f'{{"cluster":"{cluster}","kind":"LeaderClaimed","event_id":7,"block_number":5,"log_index":0}}',
        f'{{"cluster":"{cluster}","kind":"unknown","event_id":8,"block_number":6,"log_index":0}}']
    long = feeds.change_feed(rows.withColumn("kind", F.repeat(F.lit("k"), 8000))).collect()
    assert all(len(r["payload"]) > 8000 for r in long)


@pytest.mark.parametrize("value, expected", [
    ('plain', '"plain"'), ('a"b\\c', '"a\\"b\\\\c"'), ("\b\t\n\f\r", '"\\b\\t\\n\\f\\r"'),
    ("\x01\x0b\x1f", '"\\u0001\\u000b\\u001f"'), ("/é\x7f", '"/é\x7f"'), ("\\u000B", '"\\\\u000B"'), (None, "null")])
def test_canonical_text(spark, value, expected):
    row = spark.createDataFrame([(value,)], "v string").select(C.text(F.col("v")).alias("t")).first()
    assert row["t"] == expected


def test_canonical_objects(spark):
    body = C.obj({"epoch": C.integer(F.lit(7)), "cluster_address": C.text(F.lit("0x84")), "member_id": C.text(F.lit("0xea")),
                  "ok": C.boolean(F.lit(True)), "none": C.integer(F.lit(None)), "list": C.array(F.array(C.integer(F.lit(3)), C.integer(F.lit(1))))})
    assert spark.range(1).select(body.alias("j")).first()["j"] == (
        '{"cluster_address":"0x84","epoch":7,"list":[3,1],"member_id":"0xea","none":null,"ok":true}')
    point = audit.as_of_json(F.lit(45491234), F.lit(b"\xab"), F.lit(1777771500), F.lit(45491222), F.lit("head"))
    assert spark.range(1).select(point.alias("j")).first()["j"] == (
        '{"block_hash":"0xab","block_number":45491234,"block_timestamp":1777771500,"finalized_block":45491222,"safety":"head"}')
    with pytest.raises(ValueError, match="ASCII"):
        C.obj({"é": F.lit("1")})


def test_drift_and_proof_check(spark):
    events = frame(spark, [claim(1, m(1), 1), claim(2, m(2), 2), claim(1, m(1), 1, contract=a(5))])
    right = views.LEADER.replay(events, 5)
    assert audit.drift(right, right, views.CLUSTER).isEmpty() and audit.row_diff(right, right).isEmpty()
    stale = views.LEADER.replay(events.where(F.col("contract") == F.lit(CLUSTER)), 1)
    got = {bytes(r["contract"]): r["drift"] for r in audit.drift(stale, right, views.CLUSTER).collect()}
    assert got == {CLUSTER: "different", a(5): "missing"}
    assert audit.proof_check(right, events, views.LEADER, 5, one_in=1).isEmpty()
    assert audit.proof_check(stale, events, views.LEADER, 5, one_in=1).count() == 2


def test_fingerprint_does_not_depend_on_row_order(spark):
    rows = spark.createDataFrame([(1, "0x" + "%064x" % (7 ** i)) for i in range(60)], "k int, fingerprint string")
    one = audit.combined_fingerprint(rows.repartition(5), ["k"]).first()
    two = audit.combined_fingerprint(rows.orderBy(F.desc("fingerprint")), ["k"]).first()
    assert one == two and one["rows"] == 60
    other = rows.where(F.col("fingerprint") != rows.first()["fingerprint"])
    assert audit.combined_fingerprint(other, ["k"]).first()["fingerprint"] != one["fingerprint"]


def test_snapshots_fill_gaps_and_follow_the_chain(spark):
    events = frame(spark, [claim(1, m(1), 1), destroy(2), reg(2, m(3), log_index=1)])
    truth = block_frame(spark, {1: 10, 2: 20, 3: 30})
    ask = spark.createDataFrame([(CHAIN, CLUSTER, e, 3) for e in ("leader", "members", "lifecycle")],
                                "chain_id int, contract binary, endpoint string, as_of_block long")
    none = audit.materialise(audit.missing_snapshots(ask, ask.limit(0).withColumn("as_of_hash", F.lit(b"")), truth), events, truth, 3)
    stored = none.persist()
    assert {r["endpoint"]: r["payload"] for r in stored.collect()}["lifecycle"] == '{"destroyedAt":20}'
    assert stored.count() == 3
    assert audit.missing_snapshots(ask, stored, truth).isEmpty()
    moved_chain = truth.withColumn("hash", F.when(F.col("number") == 3, F.lit(m(9))).otherwise(F.col("hash")))
    assert audit.missing_snapshots(ask, stored, moved_chain).count() == 3
    fresh = audit.materialise(audit.missing_snapshots(ask, stored, moved_chain), events, moved_chain, 3)
    assert audit.put_snapshots(stored, fresh).count() == 3


def test_health_before_the_first_event(spark):
    state = spark.createDataFrame([(CHAIN, 5, None)], schemas.CHAIN_STATE)
    none = frame(spark, [])
    row = health.ingest_health(none, block_frame(spark, {1: 1}), state, reorg.orphan_blocks(none, block_frame(spark, {1: 1})), 100).first()
    assert (row["events_ingested"], row["lag_seconds"], row["finalized_block"]) == (0, -1, 0)
    names = spark.createDataFrame([("b", CHAIN), ("a", 1)], "shortname string, chain_id int")
    assert [tuple(r) for r in health.chain_summary(names, state, none).collect()] == [("a", 1, 0, 0, 0), ("b", CHAIN, 5, 0, 0)]


def test_rpc_json_source(spark, folder):
    with open(f"{folder}/logs.json", "w") as out:
        out.write('{"address":"0x%s","topics":["0x%s"],"data":"0x%s","blockNumber":"0x10","blockHash":"0x%s",'
                  '"transactionHash":"0x%s","logIndex":"0x2","removed":false}\n' % (
                      a(1).hex(), topic0("ClusterDestroyed").hex(), w(5).hex(), m(1).hex(), m(2).hex()))
        out.write('{"address":"0x%s","topics":[],"data":"0x","blockNumber":null}\n' % a(1).hex())
    rows = logs.read_rpc_logs(spark, folder, CHAIN).collect()
    assert (rows[0]["block_number"], rows[0]["log_index"], rows[0]["event_id"]) == (16, 2, None)  # the live log gives ids
    assert rows[1]["block_number"] is None
    from logtide.operators import decode
    good, rejects = decode.decode_logs(logs.read_rpc_logs(spark, folder, CHAIN))
    assert good.first()["kind"] == "ClusterDestroyed" and rejects.count() == 1


def test_backfill_finds_clusters_of_a_factory(spark, folder):
    factory, cluster = a(1), a(2)
    pad = lambda raw: raw.rjust(32, b"\0")
    rows = raw_log(spark, [([topic0("ClusterDeployed"), pad(cluster), pad(a(3)), m(1)], b""),
                           ([topic0("LeaderClaimed"), m(4), w(2)], w(32) + tail(b"")),
                           ([topic0("LeaderClaimed"), m(5), w(9)], w(32) + tail(b""))])
    emitter = F.when(F.col("event_id") == 0, F.lit(factory)).when(F.col("event_id") == 1, F.lit(cluster)).otherwise(F.lit(a(9)))
    raw = rows.withColumn("address", emitter)
    from logtide.operators import decode
    topics = [s.topic0 for s in decode.DEFAULT_SPECS]
    heads = spark.createDataFrame([(CHAIN, 200)], "chain_id int, head long")
    events, watched, cursors = backfill(
        lambda plan: ingest.scan_plan(raw, plan, topics), registry.seed_factories(spark.createDataFrame([(CHAIN, factory, 0)], FACTORIES)),
        spark.createDataFrame([], schemas.CURSOR), heads, folder)
    assert sorted(r["kind"] for r in events.collect()) == ["ClusterDeployed", "LeaderClaimed"]
    assert {bytes(r["address"]): r["from_block"] for r in watched.collect()} == {factory: 0, cluster: 100}
    assert {r["next_block"] for r in cursors.collect()} == {201} and cursors.count() == 2


def test_reader(spark):
    rows = [claim(100, m(1), 3, event_id=1), reg(100, m(1), log_index=1, event_id=2), reg(100, m(2), log_index=2, event_id=3),
            retire(150, m(2), event_id=4), destroy(150, log_index=1, event_id=5), moved(150, m(1), log_index=2, event_id=6)]
    blocks = block_frame(spark, {100: 1000, 150: 1500, 138: 1380})
    state = spark.createDataFrame([(CHAIN, 150, 138)], schemas.CHAIN_STATE)
    watched = spark.createDataFrame([(CHAIN, CLUSTER, "cluster_diamond", a(1), 100)], schemas.WATCHED)
    stored = frame(spark, rows).withColumns({c: F.lit(b"") for c in ("topic0", "topics_rest", "data")})
    reader = ChainReader(CHAIN, stored, blocks, state, watched)
    name, unknown = "0x" + CLUSTER.hex(), "0x" + m(7).hex()
    assert reader.leader(name).first()["epoch"] == 3
    assert reader.members(name).count() == 1 and reader.members(name, include_retired=True).count() == 2
    assert reader.members(name, safety="finalized").count() == 2
    assert reader.member(name, "0x" + m(2).hex()).first()["retired_at"] == 1500
    with pytest.raises(NotFound):
        reader.member(name, unknown)
    assert reader.lifecycle(name, as_of_block=100).first()["destroyed_at"] is None
    assert reader.overview(name).first()["members_count"] == 2
    assert reader.proof(name, "members", as_of_block=100).count() == 2
    page, after = reader.event_page(name, limit=2)
    assert page.count() == 2 and after == 2
    with pytest.raises(NotFound):
        reader.event(99)
    assert reader.factory_contains("0x" + a(1).hex(), name) and not reader.factory_contains("0x" + a(2).hex(), name)
    assert reader.factory_clusters("0x" + a(1).hex()).count() == 1
    assert reader.summary("main").first()["last_event_id"] == 6
    assert reader.fingerprint(name, 100).first()["fingerprint"].startswith("0x")
    with pytest.raises(ValueError, match="expected 20 bytes"):
        reader.leader("0x12")


def plan_of(frame_):
    return frame_._jdf.queryExecution().executedPlan().toString()


def test_chain_bounds_do_not_shuffle_events(spark, folder):
    rows = frame(spark, [claim(b, m(1), b) for b in range(50)])
    rows.write.parquet(f"{folder}/events")
    events = spark.read.parquet(f"{folder}/events")
    bound = rows.groupBy("chain_id").agg(F.max("block_number").alias("as_of_block"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        for joined in (views.up_to(events, bound), reorg.roll_back(events, bound.withColumnRenamed("as_of_block", "ancestor"))):
            assert "Exchange hashpartitioning(chain_id" not in plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_plans_block_range_reaches_the_scan(spark, folder):
    raw_log(spark, [([topic0("ClusterDestroyed")], w(1))]).write.parquet(f"{folder}/raw")
    plan = spark.createDataFrame([(CHAIN, CLUSTER, 40, 60)], "chain_id int, contract binary, from_block long, to_block long")
    scan = ingest.scan_plan(spark.read.parquet(f"{folder}/raw"), plan, [topic0("ClusterDestroyed").hex()])
    pushed = plan_of(scan).split("PushedFilters")[1]
    assert "GreaterThanOrEqual(block_number,40)" in pushed and "LessThanOrEqual" in pushed


def test_one_old_log_costs_one_bucket(spark, folder):
    log = EventLog(spark, f"{folder}/log", jobs.event_type())
    rows = frame(spark, [claim(b * 100_000, m(1), 1) for b in range(6)])
    log.append(rows)
    near = log.near(rows.where("block_number in (0, 500000)"))
    assert sorted(r["block_number"] for r in near.collect()) == [0, 500_000]


def test_scratch_folders_go_with_their_scope(spark):
    with scratch(spark):
        inside = sized(spark.range(3).toDF("n"), "side")
        path = inside.inputFiles()[0]
        assert inside.count() == 3
    assert not Path(path.removeprefix("file://")).exists()
    assert sized(spark.range(3).toDF("n"), "side").count() == 3
