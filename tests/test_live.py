"""The live chain: retractable state, bounded rollback, arrival ids, forks."""

import pytest
from pyspark.sql import functions as F

from logtide import schemas
from logtide.operators import ingest, reorg, views
from logtide.sources.tables import versions
from logtide.streaming import jobs, live
from tests.fixtures import CHAIN, CLUSTER, m, tail, topic0, w

B = 10  # blocks of a bucket


def h(number, branch=0):
    return bytes([branch + 1]) + number.to_bytes(31, "big")


def header(number, branch=0, parent=None, ts=None):
    return (CHAIN, number, h(number, branch), h(number - 1, branch if parent is None else parent), ts or number * 10)


def log(number, topics, data=b"", branch=0, index=0, event_id=None):
    return (event_id, CHAIN, CLUSTER, topics, data, number, h(number, branch), bytes(32), index)


def claim(number, member, epoch, branch=0, **kw):
    return log(number, [topic0("LeaderClaimed"), m(member), w(epoch)], w(32) + tail(b""), branch, **kw)


def order(number, nonce, branch=0, **kw):
    body = w(160) + w(10**9) + m(2) + m(3) + w(192) + w(0) + tail(b"x")
    return log(number, [topic0("ControlInstructionBroadcast"), m(nonce + 1), m(9), w(nonce)], body, branch, **kw)


def minted(number, cluster, branch=0, **kw):
    return log(number, [topic0("ClusterDeployed"), bytes(12) + cluster, w(1), m(3)], b"", branch, **kw)


def feed(spark, logs=(), headers=(), gone=()):
    return live.inputs(*[spark.createDataFrame(list(rows), kind) for rows, kind in (
        (logs, schemas.RAW_LOG), (headers, schemas.BLOCK), (gone, live.RETRACTED))])


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Plans over a few rows take longer to compile than to run."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture()
def chain(spark, folder):
    return live.LiveChain(spark, folder, bucket_blocks=B)


def leader(chain):
    row = chain.view("leader").first()
    return row and (bytes(row["member_id"])[0], row["epoch"])


def ids(chain):
    return {(r["block_number"], bytes(r["block_hash"])[0] - 1, r["log_index"]): r["event_id"] for r in chain.log.read().collect()}


def test_an_orphans_log_changes_nothing_however_often_it_comes(spark, chain):
    old = [header(n) for n in range(1, 26)]
    new = [header(24, 1, parent=0), header(25, 1), header(26, 1)]
    orphan = [claim(25, 5, 9), order(25, 7, index=1), minted(25, bytes([7]) * 20, index=2)]
    chain(feed(spark, [claim(3, 1, 1), claim(24, 2, 2), *orphan], old), 0)
    assert leader(chain) == (5, 9) and chain.state(chain.instructions).count() == 1
    chain(feed(spark, [claim(25, 3, 4, branch=1)], new), 1)
    assert leader(chain) == (3, 4)
    for batch_id in (2, 3, 3):  # again, again as a retry, and with a further orphan that is late
        chain(feed(spark, [*orphan, claim(24, 6, 8, index=7)]), batch_id)
        assert leader(chain) == (3, 4)
        assert chain.state(chain.instructions).isEmpty() and chain.state(chain.watched).isEmpty()
        assert chain.feed().where(F.col("v") == batch_id).isEmpty()
    removed = {(r["block_number"], bytes(r["block_hash"])[0] - 1): r["removed"] for r in chain.events().collect()}
    assert removed == {(3, 0): False, (24, 0): True, (25, 0): True, (25, 1): False}
    rolled = chain.reorgs().collect()
    assert [(r["v"], r["ancestor"], r["head"], r["blocks"], r["removed_rows"], r["status"]) for r in rolled] == [(1, 23, 26, 2, 4, "OK")]


def test_a_nonce_of_an_orphan_goes_to_its_replacement(spark, chain):
    chain(feed(spark, [order(5, 0), order(12, 1)], [header(n) for n in range(1, 13)]), 0)
    first = chain.state(chain.instructions).orderBy("nonce").collect()
    chain(feed(spark, [order(12, 1, branch=1)], [header(12, 1, parent=0), header(13, 1)]), 1)
    rows = chain.state(chain.instructions).orderBy("nonce").collect()
    assert [r["block_number"] for r in rows] == [5, 12] and rows[0]["row_id"] == first[0]["row_id"]
    assert rows[1]["row_id"] > first[1]["row_id"]
    assert [r["event_id"] for r in chain.control_feed("instruction").where("v = 1").collect()] == [rows[1]["row_id"]]


def test_delivery_hears_of_the_reorganisation(spark, folder):
    out = jobs.OrderedDelivery(spark, f"{folder}/out", lambda: 100)
    chain = live.LiveChain(spark, f"{folder}/chain", delivery=out, bucket_blocks=B)
    chain(feed(spark, [order(5, 0), order(30, 1)], [header(n) for n in range(1, 31)]), 0)
    assert [r["nonce"] for r in out.dispatched().collect()] == [0] and out.waiting.read().count() == 1
    chain(feed(spark, [order(30, 1, branch=1)], [header(30, 1, parent=0), *[header(n, 1) for n in range(31, 34)]]), 1)
    waiting = out.waiting.read().collect()
    assert [r["row_id"] for r in waiting] == [ids(chain)[30, 1, 0]]
    chain(feed(spark, [], [header(n, 1) for n in range(34, 44)]), 2)
    assert [(r["v"], r["nonce"], r["row_id"]) for r in out.dispatched().orderBy("v").collect()] == [
        (0, 0, ids(chain)[5, 0, 0]), (2, 1, ids(chain)[30, 1, 0])]


def test_only_buckets_above_the_ancestor_are_folded_again(spark, chain, monkeypatch):
    chain(feed(spark, [claim(n, n % 5, n) for n in range(1, 46)], [header(n) for n in range(1, 46)]), 0)
    read = []
    put = type(chain.views["leader"]).put
    monkeypatch.setattr(type(chain.views["leader"]), "put", lambda self, b, rows, size: (
        read.append((self.root, {r[0] for r in rows.select(F.floor(F.col("block_number") / B)).distinct().collect()},
                     rows._jdf.queryExecution().executedPlan().toString())), put(self, b, rows, size))[1])
    chain(feed(spark, [claim(44, 9, 99, branch=1)], [header(44, 1, parent=0), header(45, 1)]), 1)
    root, buckets, plan = next(x for x in read if x[0].endswith("leader"))
    assert buckets == {4} and "block_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert leader(chain) == (9, 99)
    parts = chain.views["leader"].rows(chain.cuts()).collect()
    assert {r["block_bucket"] for r in parts} == {0, 1, 2, 3, 4} and len(parts) == 5


def test_state_after_compaction_and_a_later_reorganisation(spark, chain):
    chain(feed(spark, [claim(n, 1, n) for n in range(1, 25)], [header(n) for n in range(1, 25)]), 0)
    chain(feed(spark, [claim(22, 2, 50, branch=1)], [header(22, 1, parent=0), header(23, 1), header(24, 1)]), 1)
    assert leader(chain) == (2, 50)
    chain.compact(2)
    assert leader(chain) == (2, 50) and chain.cuts() == []
    chain(feed(spark, [], [header(22, 2, parent=0), header(23, 2), header(24, 2)]), 2)
    assert leader(chain) == (1, 21)
    chain(feed(spark, [], [header(22, 1, parent=0), header(23, 1), header(24, 1), header(25, 1)]), 3)
    assert leader(chain) == (2, 50)  # the branch comes back: its logs are in the log


def test_a_cut_reaches_a_base_that_nothing_was_added_to(spark, chain):
    nonces = lambda: sorted(r["nonce"] for r in chain.state(chain.instructions).collect())
    chain(feed(spark, [order(5, 0), order(22, 1)], [header(n) for n in range(1, 23)]), 0)
    chain.compact(1)
    chain(feed(spark, [], [header(22, 1, parent=0), header(23, 1)]), 1)
    assert nonces() == [0] and chain.cuts() == [(1, CHAIN, 2)]
    chain.compact(2)
    assert nonces() == [0] and chain.cuts() == []


def test_logs_speak_for_blocks_until_a_header_does(spark, chain):
    chain(feed(spark, [claim(5, 1, 1)]), 0)
    assert chain.blocks().first()["block_ts"] == 0 and leader(chain) == (1, 1)
    chain(feed(spark, [claim(5, 2, 7, branch=1)]), 1)   # a new log with another hash: the newest evidence
    assert leader(chain) == (2, 7)
    chain(feed(spark, [claim(5, 1, 1)]), 2)             # a repeated one is no evidence
    assert leader(chain) == (2, 7)
    chain(feed(spark, [], [header(6, 0)]), 3)           # a child names its parent
    assert leader(chain) == (1, 1)
    chain(feed(spark, [claim(5, 3, 9, branch=2)], [header(5, 0)]), 4)
    assert leader(chain) == (1, 1) and chain.blocks().where("number = 5").first()["block_ts"] == 50


def test_a_retraction_takes_its_block_back(spark, chain):
    chain(feed(spark, [claim(5, 1, 1), claim(6, 2, 3)], [header(4), header(5), header(6)]), 0)
    chain(feed(spark, gone=[(CHAIN, 6, h(6)), (CHAIN, 5, h(5, 1))]), 1)   # the second was never canonical
    assert leader(chain) == (1, 1) and {r["number"] for r in chain.blocks().collect()} == {3, 4, 5}
    chain(feed(spark, [claim(6, 3, 2, branch=1)]), 2)
    assert leader(chain) == (3, 2)


def test_ids_rise_without_gaps_and_survive_retries(spark, chain, monkeypatch):
    rows = [claim(n, 1, n, index=i) for n in (3, 1, 2) for i in range(4)]
    chain(feed(spark, rows), 0)
    first = ids(chain)
    assert sorted(first.values()) == list(range(1, 13))
    assert [k for k, _ in sorted(first.items(), key=lambda kv: kv[1])] == sorted(first)
    later = [claim(n, 1, n, index=9) for n in (5, 4)] + rows[:3]
    with monkeypatch.context() as patch:   # fails after the log is written
        patch.setattr(live.LiveChain, "_canonical", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            chain(feed(spark, later), 1)
    stored = ids(chain)
    chain(feed(spark, later), 1)
    assert ids(chain) == stored and sorted(stored.values()) == list(range(1, 15))
    assert leader(chain) == (1, 5)
    chain(feed(spark, [claim(4, 2, 60, branch=1, index=9)]), 2)
    assert ids(chain)[4, 1, 9] == 15   # the fork twin at one position has an id of its own, a larger one
    assert {r["event_id"] for r in chain.feed().where("v = 1").collect()} == {13, 14, *[first[3, 0, i] for i in range(3)]}


def test_ids_of_the_source_are_kept(spark, chain):
    chain(feed(spark, [claim(1, 1, 1, event_id=40), claim(2, 1, 1)]), 0)
    assert ids(chain)[1, 0, 0] == 40
    chain(feed(spark, [claim(3, 1, 1)]), 1)
    assert ids(chain)[3, 0, 0] == 41


def test_a_retry_after_a_reorganisation_changes_nothing(spark, chain):
    chain(feed(spark, [claim(3, 1, 1), claim(15, 2, 5)], [header(n) for n in range(1, 16)]), 0)
    turn = feed(spark, [claim(15, 4, 3, branch=1)], [header(15, 1, parent=0), header(16, 1)])
    for _ in range(2):
        chain(turn, 1)
        assert leader(chain) == (4, 3) and chain.reorgs().count() == 1 and chain.cuts() == [(1, CHAIN, 1)]


def test_views_of_members_wait_for_times_only(spark, chain):
    joined = log(4, [topic0("MemberRegistered"), m(1), w(1), w(2)], w(32) + tail(b"n"))
    chain(feed(spark, [joined, log(6, [topic0("MemberRetired"), m(1)], w(7))]), 0)
    assert chain.view("members").first()["registered_at"] == 0
    chain(feed(spark, [], [header(4), header(6)]), 1)
    row = chain.view("members").first()
    assert (row["registered_at"], row["retired_at"]) == (40, 60)


# --- forks ---------------------------------------------------------------------

def settled(spark, rows):
    frame = spark.createDataFrame(rows, schemas.BLOCK).coalesce(1)
    return {r["number"]: bytes(r["hash"])[0] - 1 for r in reorg.choose_forks(frame).collect()}


def test_the_longer_branch_wins_whatever_its_hashes(spark):
    trunk = [header(n) for n in range(1, 4)]
    low = [header(4, 1, parent=0), *[header(n, 1) for n in range(5, 20)]]
    high = [header(4, 9, parent=0), header(5, 9)]
    for rows in (trunk + low + high, trunk + high + low, high + low + trunk):
        assert settled(spark, rows) == {**{n: 0 for n in range(1, 4)}, **{n: 1 for n in range(4, 20)}}


def test_of_two_tips_the_later_arrival_wins(spark):
    trunk = [header(n) for n in range(1, 4)]
    assert settled(spark, [*trunk, header(4, 9, parent=0), header(4, 1, parent=0)])[4] == 1
    assert settled(spark, [*trunk, header(4, 1, parent=0), header(4, 9, parent=0)])[4] == 9
    assert settled(spark, trunk) == {1: 0, 2: 0, 3: 0}


def test_state_tables_keep_their_versions(spark, chain):
    for b in range(3):
        chain(feed(spark, [claim(b + 1, 1, b)]), b)
    chain.compact(2)
    assert versions(spark, chain.views["leader"].base) == [1] and versions(spark, chain.views["leader"].recent) == [2]
    assert versions(spark, chain.acks.base) == versions(spark, chain.acks.recent) == []  # no rows, no files
    assert leader(chain) == (1, 2)
    assert views.LEADER.replay(chain.events()).first()["epoch"] == 2
    assert ingest.count_duplicates(chain.log.read()).first()["duplicates"] == 0


def test_a_batchs_shuffles_have_partitions_as_its_rows(spark, chain, monkeypatch):
    monkeypatch.setattr(live, "ROWS_A_TASK", 3)
    name, seen, fresh = "spark.sql.shuffle.partitions", [], chain._fresh
    monkeypatch.setattr(chain, "_fresh", lambda batch_id, events, touched: seen.append(
        events.rdd.getNumPartitions()) or fresh(batch_id, events, touched))
    before = spark.conf.get(name)
    chain(feed(spark, [claim(n, 1, n, event_id=n) for n in range(1, 40)]), 0)
    assert seen == [13] and spark.conf.get(name) == before
    assert chain.log.read().count() == 39


def test_a_first_batch_is_not_joined_with_a_log_that_is_not_there(spark, chain):
    rows = spark.createDataFrame([claim(1, 1, 1, event_id=7)], schemas.RAW_LOG)
    known = chain.log.near(rows, [(CHAIN, 0)]).select("event_id")
    plan = rows.join(known, "event_id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    chain(feed(spark, [claim(1, 1, 1, event_id=7), claim(1, 1, 1, event_id=9), claim(2, 1, 2, event_id=8)]), 0)
    chain(feed(spark, [claim(1, 1, 1, event_id=10)]), 1)
    assert sorted(r["event_id"] for r in chain.log.read().collect()) == [7, 8]
    assert sorted((r["event_id"], r["v"]) for r in chain.feed().collect()) == [(7, 0), (7, 1), (8, 0)]


def test_a_reorganisations_shuffles_have_partitions_as_the_rows_it_folds_again(spark, chain, monkeypatch):
    monkeypatch.setattr(live, "ROWS_A_TASK", 3)
    chain(feed(spark, [claim(n, 1, n, event_id=n) for n in range(1, 40)]), 0)
    seen, canonical, name = [], chain._canonical, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(chain, "_canonical", lambda events, *rest: seen.append(
        int(events.sparkSession.conf.get(name))) or canonical(events, *rest))
    chain(feed(spark, headers=[header(20, 1, parent=0)]), 1)
    assert seen == [7]  # of the 20 logs in the buckets from the ancestor's on
    assert sorted(r["event_id"] for r in chain.events().where("removed").collect()) == [20]


def test_a_batchs_shuffles_have_partitions_as_the_stored_rows_that_it_meets(spark, chain, monkeypatch):
    monkeypatch.setattr(live, "ROWS_A_TASK", 3)
    chain(feed(spark, [claim(n, 1, n, event_id=n) for n in range(1, 40)]), 0)
    seen, fresh, name = [], chain._fresh, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(chain, "_fresh", lambda batch_id, events, touched: seen.append(
        int(events.sparkSession.conf.get(name))) or fresh(batch_id, events, touched))
    before = spark.conf.get(name)
    chain(feed(spark, [claim(n, 2, n, index=1, event_id=100 + n) for n in (5, 15, 25)]), 1)
    assert seen == [11] and spark.conf.get(name) == before  # of 3 logs and the 29 in their buckets
    assert chain.log.read().count() == 42 and leader(chain) == (1, 39)


def test_a_batch_holds_no_rows_in_the_executors_memory(spark, chain, monkeypatch):
    held, canonical = [], chain._canonical
    monkeypatch.setattr(chain, "_canonical", lambda *a: held.append(
        sum(kept.memSize() for kept in spark.sparkContext._jsc.sc().getRDDStorageInfo())) or canonical(*a))
    chain(feed(spark, [claim(n, 1, n, event_id=n) for n in range(1, 9)], [header(n) for n in range(1, 9)]), 0)
    chain(feed(spark, [claim(n, 2, n + 9, index=1, event_id=n + 9) for n in range(1, 9)]), 1)   # meets stored rows
    assert held == [0, 0] and leader(chain) == (2, 17) and chain.log.read().count() == 16


def test_headers_keep_their_turn_in_a_batch_that_is_written(spark, chain):
    """Of two tips the later arrival counts, also if it lies in the smaller file, which Spark would read last or first."""
    trunk, tips = [header(n) for n in range(1, 30)], [header(30, 9, parent=0), header(30, 1, parent=0)]
    for batch_id, rows in enumerate(([*tips, *trunk], [*trunk, *tips[::-1]])):
        chain(feed(spark, headers=rows), batch_id)
        assert bytes(chain.blocks().where("number = 30").first()["hash"])[0] - 1 == (1, 9)[batch_id]
