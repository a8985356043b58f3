import random

import pytest
from pyspark.sql import functions as F

from logtide import schemas
from logtide.operators import control, orderer
from tests.fixtures import CHAIN, CLUSTER, m

NOW = 150


def instructions(spark, rows, cluster=CLUSTER):
    """Rows of (nonce, block[, expiry[, targets]])."""
    full = []
    for i, row in enumerate(rows):
        nonce, block, *more = row
        expiry = more[0] if more else 10**9
        targets = more[1] if len(more) > 1 else []
        full.append((i, CHAIN, cluster, m(nonce % 256), nonce, targets, expiry, m(9), b"c", m(8), block, i, m(7), False))
    return spark.createDataFrame(full, schemas.INSTRUCTION)


def heads(spark, head):
    return spark.createDataFrame([(CHAIN, head)], "chain_id int, head long")


def initial(spark, nonce, cluster=CLUSTER):
    return spark.createDataFrame([(CHAIN, cluster, nonce)], "chain_id int, cluster binary, initial long")


def outcomes(ordered):
    return {r["nonce"]: r["outcome"] for r in ordered.collect()}


D, A, N, X = orderer.DISPATCHED, orderer.AWAITING, orderer.NOT_FINAL, orderer.DROPPED


@pytest.mark.parametrize("rows, head, start, expected, cursor", [
    ([(0, 50)], 1000, 0, {0: D}, 1),
    ([(1, 50)], 1000, 0, {1: A}, 0),
    ([(1, 50), (0, 51)], 1000, 0, {0: D, 1: D}, 2),
    ([(3, 50)], 1000, 5, {3: X}, None),
    ([(0, 95)], 100, 0, {0: N}, None),
    ([(0, 95)], 110, 0, {0: D}, 1),
    ([(0, 98)], 0, 0, {0: D}, 1),
    ([(100, 50)], 1000, 100, {100: D}, 101),
    ([(0, 50), (2, 50), (3, 50)], 1000, 0, {0: D, 2: A, 3: A}, 1),
    ([(0, 50), (1, 995), (2, 50)], 1000, 0, {0: D, 1: N, 2: A}, 1),
    ([(0, 88)], 100, 0, {0: D}, 1),
    ([(0, 89)], 100, 0, {0: N}, None),
    ([(5, 50), (6, 50), (2, 50)], 1000, 5, {5: D, 6: D, 2: X}, 7),
])
def test_order(spark, rows, head, start, expected, cursor):
    frame, at, begin = instructions(spark, rows), heads(spark, head), initial(spark, start)
    assert outcomes(orderer.order(frame, at, begin)) == expected
    ends = orderer.cursors(frame, at, begin).collect()
    assert (ends[0]["next_expected"] if ends else None) == cursor


def fold(rows, head, start):
    """Labels by feeding rows one by one to a cursor and a buffer."""
    label, cursor, buffer = {}, start, set()
    for nonce, block in rows:
        if head and max(head - block, 0) < 12:
            label[nonce] = N
        elif nonce < cursor:
            label[nonce] = X
        else:
            label[nonce] = A
            buffer.add(nonce)
            while cursor in buffer:
                label[cursor] = D
                cursor += 1
    return label, cursor


def test_order_equals_a_sequential_fold_over_many_clusters(spark):
    rng = random.Random(3)
    full, expected, starts = [], {}, []
    for i in range(60):
        cluster = i.to_bytes(20, "big")
        start = rng.choice([0, 0, 3])
        nonces = rng.sample(range(12), rng.randrange(1, 12))
        rows = [(n, rng.choice([50, 60, 95])) for n in nonces]
        expected[cluster] = fold(rows, 100, start)
        starts.append((CHAIN, cluster, start))
        full += [(len(full) + j, CHAIN, cluster, m(0), n, [], 1, m(0), b"", m(0), b, 0, m(0), False)
                 for j, (n, b) in enumerate(rows)]
    frame = spark.createDataFrame(full, schemas.INSTRUCTION)
    begin = spark.createDataFrame(starts, "chain_id int, cluster binary, initial long")
    got = {}
    for r in orderer.order(frame, heads(spark, 100), begin).collect():
        got.setdefault(bytes(r["cluster"]), {})[r["nonce"]] = (r["outcome"], r["next_expected"])
    assert {c: {n: o for n, (o, _) in v.items()} for c, v in got.items()} == {
        c: labels for c, (labels, _) in expected.items()}
    for cluster, found in got.items():
        assert {e for _, e in found.values()} == {expected[cluster][1]}


def test_one_cluster_holding_most_rows_spreads_over_tasks(spark):
    hot = spark.range(20000).where("id <> 15000").select(
        F.col("id").alias("row_id"), F.lit(CHAIN).alias("chain_id"), F.lit(CLUSTER).alias("cluster"),
        F.lit(m(1)).alias("instruction_id"), F.col("id").alias("nonce"), F.array().cast("array<binary>").alias("target_members"),
        F.lit(10**9).cast("long").alias("expiry"), F.lit(m(1)).alias("salt"), F.lit(b"").alias("ciphertext"),
        F.lit(m(1)).alias("ciphertext_hash"), F.lit(1).cast("long").alias("block_number"),
        F.lit(0).cast("long").alias("log_index"), F.lit(m(1)).alias("tx_hash"), F.lit(False).alias("removed"))
    end = orderer.cursors(hot, heads(spark, 100)).first()
    assert (end["next_expected"], end["highest_buffered"], end["buffered"]) == (15000, 19999, 4999)
    plan = orderer.order(hot, heads(spark, 100))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("rows, buffered_at, options, expected", [
    ([(5, 50, 100)], None, {}, (0, 5, "buffer_expired")),
    ([(5, 50, NOW)], None, {}, (0, 5, "buffer_expired")),
    ([(1, 50), (2, 50), (3, 50)], None, {"max_buffer": 2}, (0, 3, "buffer_full")),
    ([(1, 50), (2, 50)], None, {"max_buffer": 2}, None),
    ([(1, 50)], NOW, {"max_age": 0}, (0, 1, "buffer_age")),
    ([(1, 50)], NOW - 3599, {}, None),
    ([(1, 50)], NOW - 3600, {}, (0, 1, "buffer_age")),
    ([(0, 50)], None, {}, None),
    ([(1, 50, 100), (2, 50), (3, 50)], NOW - 9999, {"max_buffer": 1}, (0, 3, "buffer_expired")),
])
def test_holes(spark, rows, buffered_at, options, expected):
    frame = instructions(spark, rows)
    if buffered_at is not None:
        frame = frame.withColumn("buffered_at", F.lit(buffered_at).cast("long"))
    found = orderer.find_holes(orderer.order(frame, heads(spark, 1000)), NOW, **options).collect()
    got = [(r["missing_nonce"], r["highest_buffered"], r["reason"]) for r in found]
    assert got == ([expected] if expected else [])


def hole_table(spark, rows):
    return spark.createDataFrame(rows, schemas.HOLE)


def test_hole_upsert_reopens_and_keeps_first_sighting(spark):
    stored = hole_table(spark, [(CHAIN, CLUSTER, 0, 3, "buffer_full", 10, 20), (CHAIN, CLUSTER, 7, 9, "manual", 11, 12)])
    seen = spark.createDataFrame(
        [(CHAIN, CLUSTER, 0, 5, "buffer_age"), (CHAIN, CLUSTER, 4, 6, "buffer_expired")],
        "chain_id int, cluster binary, missing_nonce long, highest_buffered long, reason string")
    found = {r["missing_nonce"]: tuple(r)[3:] for r in control.record_holes(stored, seen, 99).collect()}
    assert found == {0: (5, "buffer_age", 10, None), 4: (6, "buffer_expired", 99, None), 7: (9, "manual", 11, 12)}
    assert [r["missing_nonce"] for r in control.open_holes(control.record_holes(stored, seen, 99)).collect()] == [0, 4]


def test_hole_closes_when_its_nonce_arrives(spark):
    stored = hole_table(spark, [(CHAIN, CLUSTER, 0, 3, "buffer_full", 10, None), (CHAIN, CLUSTER, 9, 9, "manual", 10, 11)])
    frame = instructions(spark, [(1, 50), (2, 50), (3, 50), (0, 60)])
    ordered = orderer.order(frame, heads(spark, 1000))
    assert outcomes(ordered) == {0: D, 1: D, 2: D, 3: D}
    assert [r["missing_nonce"] for r in orderer.closed_holes(stored, ordered).collect()] == [0]
    after = {r["missing_nonce"]: (r["resolved_at"], r["changed"])
             for r in control.resolve_holes(stored, ordered, 77).collect()}
    assert after == {0: (77, True), 9: (11, False)}


def test_reorg_eviction(spark):
    rows = instructions(spark, [(1, 60), (2, 70)])
    cut = spark.createDataFrame([(CHAIN, 65)], "chain_id int, ancestor long")
    assert [r["nonce"] for r in orderer.evict_above(rows, cut).collect()] == [1]
    elsewhere = spark.createDataFrame([(1, 65)], "chain_id int, ancestor long")
    assert orderer.evict_above(rows, elsewhere).count() == 2


def test_sink_keeps_the_first_live_row(spark):
    batch = instructions(spark, [(0, 50), (0, 51), (1, 52), (2, 53)])
    removed = batch.withColumn("removed", F.col("row_id") == 2)
    kept = control.add_instructions(removed)
    assert sorted((r["row_id"], r["nonce"]) for r in kept.collect()) == [(0, 0), (3, 2)]
    stored = instructions(spark, [(0, 1)]).withColumn("removed", F.lit(True))
    assert control.add_instructions(batch, stored).count() == 3
    assert control.add_instructions(batch, stored.withColumn("removed", F.lit(False))).count() == 2


def test_ack_key_with_and_without_member(spark):
    ack = lambda i, member: (i, CHAIN, CLUSTER, m(1), m(2), m(member), 1, 5, None, None, 10, 0, m(0), False)
    batch = spark.createDataFrame([ack(0, 1), ack(1, 2), ack(2, 1)], schemas.ACK)
    assert [r["row_id"] for r in control.add_acks(batch).collect()] == [0]
    assert sorted(r["row_id"] for r in control.add_acks(batch, per_member=True).collect()) == [0, 1]


def test_targets_backlog_and_audience(spark):
    rows = instructions(spark, [(0, 50, 9, []), (1, 50, 9, [m(1)]), (2, 50, 9, [m(2), m(2)]), (3, 90, 9, [])])
    assert [r["nonce"] for r in control.member_backlog(rows, m(1), 0, 60).collect()] == [0, 1]
    assert [r["nonce"] for r in control.member_backlog(rows, m(1), 1, 60).collect()] == [1]
    feed = control.by_audience(rows)
    assert feed.count() == 4
    assert sorted(r["nonce"] for r in control.addressed_to(feed, m(2)).collect()) == [0, 2, 3]


def test_cold_start_cursor(spark):
    rows = instructions(spark, [(0, 50), (4, 60), (9, 90)])
    clusters = spark.createDataFrame([(CHAIN, CLUSTER), (CHAIN, bytes(20))], "chain_id int, cluster binary")
    best = {bytes(r["cluster"]): r["highest_nonce"] for r in control.highest_final_nonce(rows, clusters, 80).collect()}
    assert best == {CLUSTER: 4, bytes(20): None}
    start = {bytes(r["cluster"]): r["initial"] for r in control.start_cursors(rows, clusters, 80).collect()}
    assert start == {CLUSTER: 5, bytes(20): 0}


def test_connect_feed_puts_open_holes_first(spark):
    holes = hole_table(spark, [(CHAIN, CLUSTER, 8, 9, "buffer_age", 10, None), (CHAIN, CLUSTER, 1, 2, "manual", 1, 2)])
    backlog = control.final_since(instructions(spark, [(3, 50), (2, 50)]), 0, 100)
    frames = control.connect_feed(holes, backlog).collect()
    assert [(r["frame"], r["nonce"]) for r in frames] == [("hole", 8), ("instruction", 2), ("instruction", 3)]
