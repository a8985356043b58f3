import pytest
from pyspark.sql import functions as F

from logtide.operators import asof, views
from tests.fixtures import (
    CHAIN, CLUSTER, a, block_frame, claim, destroy, fold, frame, m, moved, random_events, reg, retire,
)

ZERO = bytes(32)
TIMES = {100: 1700000000, 150: 1700001000, 200: 1700002000, 500: 1700005000}


def leader(spark, rows, as_of):
    clusters = spark.createDataFrame([(CHAIN, CLUSTER)], "chain_id int, contract binary")
    row = views.leader_for(clusters, views.LEADER.replay(frame(spark, rows), as_of), as_of).first()
    assert row["as_of_block"] == as_of
    return bytes(row["member_id"]), row["epoch"]


def members(spark, rows, as_of, times=TIMES):
    found = views.MEMBERS.replay(frame(spark, rows), as_of, block_frame(spark, times))
    return views.in_member_order(found).collect()


def ended(spark, rows, as_of, times=TIMES):
    found = views.LIFECYCLE.replay(frame(spark, rows), as_of, block_frame(spark, times)).collect()
    return found[0]["destroyed_at"] if found else None


@pytest.mark.parametrize("rows, as_of, expected", [
    ([], 100, (ZERO, 0)),
    ([claim(100, m(1), 1), claim(200, m(2), 2), claim(300, m(3), 3)], 1000, (m(3), 3)),
    ([claim(100, m(0xaa), 5), claim(200, m(0xbb), 3)], 1000, (m(0xaa), 5)),
    ([claim(100, m(0xaa), 7), claim(200, m(0xbb), 7)], 1000, (m(0xaa), 7)),
    ([claim(200, m(0xbb), 7), claim(100, m(0xaa), 7)], 1000, (m(0xaa), 7)),
    ([claim(100, m(1), 1), claim(500, m(2), 2)], 200, (m(1), 1)),
    ([claim(100, m(1), 1), claim(500, m(2), 2)], 500, (m(2), 2)),
    ([claim(100, m(1), 1), claim(200, m(2), 9, removed=True)], 500, (m(1), 1)),
])
def test_leader(spark, rows, as_of, expected):
    assert leader(spark, rows, as_of) == expected


def test_wide_epochs_win_and_fail_a_narrow_read(spark):
    events = frame(spark, [claim(100, m(1), 3), claim(200, m(2), 2**64), claim(300, m(3), 2**63, log_index=1)])
    rows = views.LEADER.partial(views.LEADER.events(events, 500))
    row, = views.wide_leaders(rows).collect()
    assert (bytes(row["member_id"]), row["epoch"]) == (m(2), str(2**64))
    with pytest.raises(Exception, match="leader epoch past 64 bits: 18446744073709551616"):
        views.LEADER.finish(rows).collect()


def test_members_register_endpoint_and_redelivery(spark):
    rows = [reg(100, m(1), "a"), moved(150, m(1), b"https://here"), reg(100, m(1), "a")]
    row, = members(spark, rows, 1000)
    assert (row["dns_label"], row["public_endpoint"], row["registered_at"]) == ("a", "https://here", TIMES[100])


def test_members_retire_cutoff_stub_and_unknown(spark):
    rows = [reg(100, m(1)), retire(500, m(1))]
    assert members(spark, rows, 1000)[0]["retired_at"] == TIMES[500]
    assert members(spark, rows, 200)[0]["retired_at"] is None
    stub, = members(spark, [moved(100, m(2))], 1000)
    assert stub["dns_label"] is None and stub["registered_at"] is None
    assert members(spark, [retire(100, m(3))], 1000) == []
    late, = members(spark, [retire(100, m(3)), reg(150, m(3))], 1000)
    assert late["retired_at"] is None


def test_members_sort_by_id_bytes_and_non_utf8_endpoint(spark):
    rows = [reg(100, m(0xff), "z"), reg(100, m(1), "a", 1), reg(100, m(0x80), "m", 2),
            moved(150, m(1), b"\xff")]
    found = members(spark, rows, 200)
    assert [r["dns_label"] for r in found] == ["a", "m", "z"]
    assert found[0]["public_endpoint"] == "0xff"


def test_member_events_without_a_block_row_drop_out(spark):
    rows = [reg(100, m(1), "kept"), reg(120, m(1), "no block")]
    assert members(spark, rows, 1000)[0]["dns_label"] == "kept"


def test_active_filter(spark):
    found = views.MEMBERS.replay(frame(spark, [reg(100, m(1)), retire(500, m(1)), reg(100, m(2), log_index=1)]),
                                 1000, block_frame(spark, TIMES))
    assert views.active(found).count() == 1
    assert views.active(found, include_retired=True).count() == 2


def test_lifecycle(spark):
    rows = [destroy(200), destroy(500), claim(100, m(1), 1)]
    assert ended(spark, [], 1000) is None
    assert ended(spark, rows, 1000) == TIMES[200]
    assert ended(spark, rows, 199) is None
    assert ended(spark, rows, 200) == TIMES[200]


@pytest.mark.parametrize("seed", [1, 2])
def test_aggregates_equal_a_sequential_fold(spark, seed):
    rows = random_events(seed)
    times = {n: 1000 + n for n in range(1, 40) if n % 7}
    events, blocks = frame(spark, rows + rows[:50]), block_frame(spark, times)
    leaders, known, ends = fold(rows, times, 30)
    got = {bytes(r["contract"]): (bytes(r["member_id"]), r["epoch"])
           for r in views.LEADER.replay(events, 30).collect()}
    assert got == leaders
    columns = ["instance_id", "passthrough", "dns_label", "public_endpoint", "registered_at", "retired_at"]
    got = {(bytes(r["contract"]), bytes(r["member_id"])): [
        bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns]
        for r in views.MEMBERS.replay(events, 30, blocks).collect()}
    assert got == known
    got = {bytes(r["contract"]): r["destroyed_at"] for r in views.LIFECYCLE.replay(events, 30, blocks).collect()}
    assert got == ends


@pytest.mark.parametrize("name", list(views.VIEWS))
def test_incremental_equals_replay_in_any_order(spark, name):
    view = views.VIEWS[name]
    rows = random_events(5)
    blocks = block_frame(spark, {n: n for n in range(1, 40)})
    state = view.partial(frame(spark, []))
    for part in (rows[200:], rows[:250], rows[100:300]):
        state = view.apply(state, frame(spark, part), blocks)
    whole = view.replay(frame(spark, rows), None, blocks)
    assert view.finish(state, blocks).exceptAll(whole).isEmpty()
    assert whole.exceptAll(view.finish(state, blocks)).isEmpty()


def test_reports(spark):
    rows = [claim(100, m(1), 5), claim(200, m(2), 5), claim(150, m(1), 4), claim(160, m(1), 4),
            moved(100, m(1)), reg(200, m(1)), retire(100, m(7)), reg(100, m(9), log_index=5),
            retire(200, m(9), log_index=6)]
    events = frame(spark, rows)
    conflict, = views.leader_conflicts(events).collect()
    assert (conflict["epoch"], conflict["claims"]) == (5, 2)
    found = {bytes(r["member_id"]): (r["endpoint_before_register"], r["retire_of_unknown"])
             for r in views.member_anomalies(events, block_frame(spark, TIMES)).collect()}
    assert found == {m(1): (True, False), m(7): (False, True)}


def test_overview_counts_retired_members(spark):
    rows = [claim(100, m(1), 3), reg(100, m(1), log_index=1), reg(100, m(2), log_index=2), retire(200, m(2))]
    clusters = spark.createDataFrame([(CHAIN, CLUSTER), (CHAIN, bytes(20))], "chain_id int, contract binary")
    found = {bytes(r["contract"]): r for r in views.overview(
        clusters, frame(spark, rows), block_frame(spark, TIMES), 300).collect()}
    assert (found[CLUSTER]["members_count"], found[CLUSTER]["active_count"]) == (2, 1)
    assert (found[bytes(20)]["members_count"], bytes(found[bytes(20)]["member_id"])) == (0, ZERO)


def test_request_options():
    assert asof.check_request(None, None) == "head"
    with pytest.raises(ValueError, match="not both"):
        asof.check_request("head", 5)
    with pytest.raises(ValueError, match="no such safety"):
        asof.check_request("latest", None)


def test_strict_resolution(spark):
    blocks = block_frame(spark, {n: n * 10 for n in range(0, 21)})
    state = spark.createDataFrame([(CHAIN, 20, 8)], "chain_id int, head long, finalized long")
    assert asof.resolve_one(state, blocks, CHAIN).block_number == 20
    point = asof.resolve_one(state, blocks, CHAIN, "finalized")
    assert (point.block_number, point.block_timestamp, point.safety) == (8, 80, "finalized")
    assert asof.resolve_one(state, blocks, CHAIN, None, 5).safety == "head"
    with pytest.raises(asof.NotFound, match="past_head"):
        asof.resolve_one(state, blocks, CHAIN, None, 21)
    with pytest.raises(asof.NotFound, match="no_block_row"):
        asof.resolve_one(state, blocks.where(F.col("number") != 5), CHAIN, None, 5)


def test_many_blocks_at_once_equal_a_replay_for_each(spark):
    """Every cluster as of many blocks, buckets of several sizes: the same as one replay a block."""
    rows = random_events(5, clusters=4, count=300)
    times = {n: n * 10 for n in range(1, 40) if n % 7}
    events, blocks = frame(spark, rows), block_frame(spark, times)
    asks = [(i, CHAIN, a(c), n) for i, (c, n) in enumerate((c, n) for c in range(5) for n in (0, 1, 6, 7, 8, 20, 39, 100))]
    requests = spark.createDataFrame(asks, "request_id int, chain_id int, contract binary, as_of_block long")
    for view in views.VIEWS.values():
        want = {}
        for n in {x[3] for x in asks}:
            for r in view.replay(events, n, blocks).collect():
                want.setdefault((bytes(r["contract"]), n), []).append(tuple(r)[2:])
        for size in (1, 7, 1000):
            got = {}
            for r in views.as_of_many(view, events, requests, blocks, size).select(
                    "request_id", "as_of_block", *view.finish(view.partial(events), blocks).columns).collect():
                got.setdefault((bytes(r["contract"]), r["as_of_block"]), []).append(tuple(r)[4:])
            key = lambda v: [str(x) for x in v]
            assert {k: sorted(v, key=key) for k, v in got.items()} == {
                k: sorted(v, key=key) for k, v in want.items() if k[0] in {x[2] for x in asks}}
