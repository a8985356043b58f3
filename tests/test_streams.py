import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from logtide import schemas
from logtide.operators import control, orderer, views
from logtide.plans import catalog
from logtide.session import byte_size, frugal
from logtide.sources import logs, sample_tables
from logtide.sources.raw_log import RawLog
from logtide.sources.tables import EventLog, MergeTable, VersionedTable, versions
from logtide.streaming import jobs, live
from tests.fixtures import CHAIN, CLUSTER, block_frame, claim, frame, m, raw_log, tail, topic0, w
from tests.test_control import fold


def step(kind, seq, block, nonce=None, cluster=CLUSTER, expiry=10**9):
    return (kind, seq, seq, CHAIN, cluster, m(1), nonce, [], expiry, m(2), b"", m(3), block, 0, m(4), False)


def batch(spark, steps):
    return spark.createDataFrame(steps, jobs.ORDERER_INPUT)


def delivery(spark, folder, clock=lambda: 100, **options):
    return jobs.OrderedDelivery(spark, folder, clock, **options)


def sent(job):
    return [(r["v"], r["nonce"]) for r in job.dispatched().orderBy("v", "nonce").collect()]


def test_gap_then_close_over_batches_with_a_retry(spark, folder):
    job = delivery(spark, folder, max_buffer=2)
    job(batch(spark, [step("head", 0, 1000), *[step("instruction", i, 50, i) for i in (1, 2, 3)]]), 0)
    assert sent(job) == []
    hole = job.holes.read().first()
    assert (hole["missing_nonce"], hole["highest_buffered"], hole["reason"], hole["resolved_at"]) == (0, 3, "buffer_full", None)
    last = batch(spark, [step("instruction", 9, 60, 0)])
    for _ in range(2):   # the second run is a retry of the same batch
        job(last, 1)
        assert sent(job) == [(1, 0), (1, 1), (1, 2), (1, 3)]
        assert job.holes.read().first()["resolved_at"] == 100
        assert job.cursors.read().first()["initial"] == 4
    job(batch(spark, [step("instruction", 12, 60, 2), step("instruction", 13, 61, 4)]), 2)
    assert sent(job)[4:] == [(2, 4)]
    assert job.waiting.read().isEmpty()


def test_rows_become_final_when_the_head_moves(spark, folder):
    job = delivery(spark, folder)
    job(batch(spark, [step("head", 0, 100), step("instruction", 1, 95, 0)]), 0)
    assert sent(job) == [] and job.waiting.read().count() == 1
    job(batch(spark, [step("head", 2, 110)]), 1)
    assert sent(job) == [(1, 0)]


def test_reorg_rows_take_back_what_arrived_before_them(spark, folder):
    job = delivery(spark, folder)
    job(batch(spark, [step("head", 0, 200), step("instruction", 1, 60, 1), step("instruction", 2, 70, 2)]), 0)
    job(batch(spark, [step("instruction", 3, 80, 3), step("reorg", 4, 65), step("instruction", 5, 81, 4)]), 1)
    assert sorted(r["nonce"] for r in job.waiting.read().collect()) == [1, 4]
    job(batch(spark, [step("instruction", 6, 82, 0)]), 2)
    assert sent(job) == [(2, 0), (2, 1)]
    job(batch(spark, [step("instruction", 7, 83, 2), step("instruction", 8, 84, 3)]), 3)
    assert sent(job)[2:] == [(3, 2), (3, 3), (3, 4)]


def test_age_and_expiry_follow_the_clock(spark, folder):
    now = [100]
    job = delivery(spark, folder, clock=lambda: now[0])
    job(batch(spark, [step("head", 0, 200), step("instruction", 1, 60, 1, expiry=5000)]), 0)
    assert job.holes.read().isEmpty()
    now[0] = 3700
    job(batch(spark, [step("head", 2, 201)]), 1)
    assert job.holes.read().first()["reason"] == "buffer_age"
    now[0] = 5000
    job(batch(spark, [step("head", 3, 202)]), 2)
    hole = job.holes.read().first()
    assert (hole["reason"], hole["observed_at"]) == ("buffer_expired", 3700)


def test_streamed_delivery_equals_batch_and_fold(spark, folder):
    rng = random.Random(11)
    steps, want = [step("head", 0, 1000)], {}
    for c in range(8):
        cluster = bytes([c]) * 20
        nonces = rng.sample(range(10), rng.randrange(3, 10))
        want[cluster] = [n for n, o in fold([(n, 50) for n in nonces], 1000, 0)[0].items() if o == orderer.DISPATCHED]
        steps += [step("instruction", 0, 50, n, cluster) for n in nonces]
    rng.shuffle(steps)
    steps = [(s[0], i, i, *s[3:]) for i, s in enumerate(steps)]
    source = f"{folder}/in"
    for i in range(0, len(steps), 15):
        batch(spark, steps[i:i + 15]).coalesce(1).write.mode("append").parquet(source)
    stream = logs.stream_table(spark, source, jobs.ORDERER_INPUT, files_per_batch=1)
    for _ in range(2):   # a second start resumes from the checkpoint and finds nothing new
        job = delivery(spark, f"{folder}/state")
        jobs.run(stream, job, f"{folder}/checkpoint").awaitTermination()
        got = {}
        for r in job.dispatched().orderBy("v", "nonce").collect():
            got.setdefault(bytes(r["cluster"]), []).append(r["nonce"])
        assert got == {c: sorted(n) for c, n in want.items() if n}
    rows = batch(spark, steps).where("row_type = 'instruction'").drop("row_type", "seq")
    ordered = orderer.order(control.add_instructions(rows), spark.createDataFrame([(CHAIN, 1000)], "chain_id int, head long"))
    assert ordered.where(F.col("outcome") == orderer.DISPATCHED).count() == job.dispatched().count()


def ingest_rows(spark):
    return raw_log(spark, [
        ([topic0("LeaderClaimed"), m(1), w(1)], w(32) + tail(b"")),
        ([topic0("LeaderClaimed"), m(2), w(5)], w(32) + tail(b"")),
        ([topic0("ClusterDestroyed")], w(1)), ([bytes(32)], b"")])


def test_live_chain_takes_batches_again(spark, folder):
    chain = live.LiveChain(spark, folder)
    headers = block_frame(spark, {n: n for n in range(100, 104)}).withColumn("hash", F.lit(bytes(31) + b"\x01"))
    rows = ingest_rows(spark).withColumn("block_hash", F.lit(bytes(31) + b"\x01"))
    chain(live.inputs(rows, headers), 0)
    chain(live.inputs(rows, headers), 0)
    chain(live.inputs(rows.where("event_id < 2")), 1)
    assert chain.log.read().count() == 4
    assert chain.view("leader").first()["epoch"] == 5
    assert chain.view("lifecycle").first()["destroyed_at"] == 102
    assert chain.feed().where("payload like '%unknown%'").count() == 1


def test_compaction_changes_no_answer_and_spares_the_running_batch(spark, folder):
    view = views.LEADER
    part = lambda n, e: view.partial(frame(spark, [claim(n, m(e), e)]))
    table = MergeTable(spark, folder, view.merge, part(1, 1).schema)
    for i in range(4):
        table.put(i, part(10 + i, i))
    before = view.finish(table.read(), None).collect()
    table.compact(before=3)
    assert (versions(spark, table.base), versions(spark, table.recent)) == ([2], [3])
    assert view.finish(table.read(), None).collect() == before
    assert view.finish(table.read(before=3), None).first()["epoch"] == 2
    table.compact(before=3)
    assert view.finish(table.read(), None).collect() == before


def test_versioned_table_reads_what_came_before(spark, folder):
    table = VersionedTable(spark, folder, schemas.CURSOR)
    assert table.read().isEmpty()
    for i in range(6):
        table.write(i, spark.createDataFrame([(CHAIN, CLUSTER, i)], schemas.CURSOR))
    assert table.read().first()["next_block"] == 5 and table.read(before=5).first()["next_block"] == 4
    assert versions(spark, folder) == [2, 3, 4, 5]


def test_event_log_prunes_to_the_buckets_of_a_batch(spark, folder):
    first = frame(spark, [claim(5, m(1), 1), claim(250_000, m(1), 2)])
    log = EventLog(spark, folder, first.schema)
    assert log.read().isEmpty()
    log.append(first)
    near = log.near(frame(spark, [claim(250_001, m(1), 3)]))
    assert [r["block_number"] for r in near.collect()] == [250_000]
    scan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "block_bucket" in scan.split("PartitionFilters")[1].split("]")[0]
    assert log.read().count() == 2


def test_block_job_signals_the_reorg_it_stores(spark, folder):
    job = jobs.BlockJob(spark, folder)
    header = lambda n, h, p: (CHAIN, n, m(h), m(p), n * 10)
    frames = [spark.createDataFrame(rows, schemas.BLOCK) for rows in (
        [header(1, 1, 0), header(2, 2, 1)], [header(3, 9, 8)], [header(2, 8, 1)])]
    for i, rows in enumerate(frames):
        job(rows, i)
    job(frames[2], 2)
    got = {(r["number"], r["parent_mismatch"], r["hash_changed"]) for r in job.signals().collect()}
    assert got == {(3, True, False), (2, False, True)}
    assert {r["number"]: bytes(r["hash"])[0] for r in job.blocks().collect()} == {1: 1, 2: 8, 3: 9}


def test_stream_guards(spark, folder):
    ingest_rows(spark).write.parquet(f"{folder}/raw")
    watched = spark.createDataFrame([(CHAIN, CLUSTER)], "chain_id int, address binary")
    stream = logs.stream_logs(spark, f"{folder}/raw")
    for name, table, expected in (("in", watched, 4), ("out", watched.limit(0), 0)):
        query = jobs.watched_only(stream, table).writeStream.format("parquet").option(
            "checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start(f"{folder}/{name}")
        query.awaitTermination()
        assert spark.read.schema(schemas.RAW_LOG).parquet(f"{folder}/{name}").count() == expected


def test_forks_inside_one_batch_are_signalled_and_settled(spark, folder):
    rows = [(CHAIN, n, h, p, n) for n, h, p in ((1, m(1), m(0)), (2, m(2), m(1)), (2, m(0x22), m(1)), (3, m(3), m(0x22)))]
    job = jobs.BlockJob(spark, folder)
    job(spark.createDataFrame(rows, schemas.BLOCK), 0)
    assert sorted((r["number"], r["hash_changed"], r["parent_mismatch"]) for r in job.signals().collect()) == [
        (2, True, False), (3, False, True)]
    assert {r["number"]: bytes(r["hash"]) for r in job.blocks().collect()} == {1: m(1), 2: m(0x22), 3: m(3)}


def test_nothing_is_delivered_before_a_head_is_known(spark, folder):
    job = delivery(spark, folder)
    job(batch(spark, [step("instruction", 0, 50, 0)]), 0)
    assert sent(job) == [] and job.waiting.read().count() == 1
    job(batch(spark, [step("head", 1, 1000)]), 1)
    assert sent(job) == [(1, 0)]


def test_a_minted_cluster_is_watched_with_what_it_emitted_before(spark, folder):
    minted, stranger = bytes([7]) * 20, bytes([9]) * 20
    address = F.when(F.col("event_id").isin(0, 2), F.lit(minted)).when(F.col("event_id") == 3, F.lit(stranger)).otherwise(F.lit(CLUSTER))
    logs_ = raw_log(spark, [
        ([topic0("LeaderClaimed"), m(1), w(1)], w(32) + tail(b"")),
        ([topic0("ClusterDeployed"), bytes(12) + minted, w(1), m(3)], b""),
        ([topic0("LeaderClaimed"), m(2), w(5)], w(32) + tail(b"")),
        ([topic0("LeaderClaimed"), m(3), w(9)], w(32) + tail(b"")),
    ]).withColumn("address", address)
    seed = spark.createDataFrame([(CHAIN, CLUSTER, "factory", None, 0)], schemas.WATCHED)
    backlog = RawLog(spark, f"{folder}/raw")
    backlog.append(logs_)
    chain = live.LiveChain(spark, f"{folder}/chain", seed=seed, backlog=backlog)
    chain(live.inputs(logs_.where("event_id = 0")), 0)
    assert chain.log.read().isEmpty()
    chain(live.inputs(logs_.where("event_id = 1")), 1)
    chain(live.inputs(logs_.where("event_id > 1")), 2)
    kept = {(bytes(r["contract"]), r["event_id"]) for r in chain.log.read().collect()}
    assert (minted, 2) in kept and (minted, 0) not in kept  # nothing comes from before the deployment and not any(c == stranger for c, _ in kept)


def test_a_view_of_the_users_own_is_kept(spark, folder):
    count = views.StateView(
        "claims", ("LeaderClaimed",), ("chain_id", "contract"),
        lambda e: e.groupBy("chain_id", "contract").agg(F.collect_set("event_id").alias("ids")),
        lambda r: r.groupBy("chain_id", "contract").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")),
        lambda r, _b=None: r.select("chain_id", "contract", F.size("ids").alias("claims")))
    chain = live.LiveChain(spark, folder, view_specs=[count])
    chain(live.inputs(ingest_rows(spark)), 0)
    chain(live.inputs(ingest_rows(spark).where("event_id < 1")), 1)
    assert chain.view("claims").first()["claims"] == 2


def test_raw_log_scans_by_folder_topic_and_address(spark, folder):
    """Rows that fit, and a plan in which folders, topics and addresses reach the scan."""
    rows = ingest_rows(spark).unionByName(ingest_rows(spark).withColumns({
        "block_number": F.col("block_number") + 500, "address": F.lit(bytes([3]) * 20)}))
    table = RawLog(spark, folder, bucket_blocks=100)
    table.append(rows.unionByName(rows.limit(1).withColumn("block_number", F.lit(None).cast("long"))))
    contracts = spark.createDataFrame([(CHAIN, bytes([3]) * 20, 601)], "chain_id int, address binary, from_block long")
    scan = table.scan([topic0("LeaderClaimed").hex()], 0, 600, contracts)
    assert [r["block_number"] for r in scan.collect()] == [600]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    pushed, parts = plan.split("PushedFilters: [")[1].split("]")[0], plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "block_bucket" in parts and "topic0" in pushed and "address" in pushed and "block_number" in pushed
    later = table.since(contracts)
    assert sorted(r["block_number"] for r in later.collect()) == [601, 602, 603]
    assert "block_bucket" in later._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert table.read().count() == 9


def test_a_batch_of_delivery_writes_what_it_changes(spark, folder):
    job = delivery(spark, folder, max_buffer=5)
    job(batch(spark, [step("head", 0, 1000), *[step("instruction", i, 50, i) for i in range(1, 200)]]), 0)
    written = lambda table, v: spark.read.parquet(f"{table.table.recent}/v={v}")
    assert written(job.waiting, 0).count() == 199 and written(job.holes, 0).count() == 1
    job(batch(spark, [step("instruction", 300, 50, 300)]), 1)
    assert [r["nonce"] for r in written(job.waiting, 1).collect()] == [300] and job.waiting.read().count() == 200
    job(batch(spark, []), 2)
    assert written(job.waiting, 2).isEmpty() and written(job.holes, 2).isEmpty()
    job(batch(spark, [step("reorg", 400, 49), step("instruction", 401, 50, 0), step("instruction", 402, 50, 2)]), 3)
    changes = {r["nonce"]: r["gone"] for r in written(job.waiting, 3).collect()}
    assert changes == {**{n: True for n in range(1, 200)}, 300: True, 2: False}
    job.waiting.compact(4)
    assert [r["nonce"] for r in job.waiting.read().collect()] == [2]
    assert spark.read.parquet(f"{job.waiting.table.base}/v=3").count() == 1


def test_events_in_one_row_group_are_dealt_to_all_tasks(spark, folder, monkeypatch):
    """Many splits over one row group: all rows lie in one of them."""
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    sizes = lambda: [r["n"] for r in sample_tables.table(spark, folder, "events").groupBy(
        F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        assert sum(sizes()) == 4000 and max(sizes()) < 2000
        # tasks grow in number with the table, not in size
        monkeypatch.setattr(sample_tables, "BYTES_A_TASK", 500)
        assert sum(sizes()) == 4000 and len(sizes()) > 16
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_a_batch_of_files_is_read_in_bounded_splits(spark, folder, monkeypatch):
    """Few large files: splits follow the job's bound, not Spark's larger one, and the session keeps its own."""
    monkeypatch.setattr(jobs, "SPLIT_BYTES", 100_000)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    rows = spark.range(40_000).select(F.lit("head").alias("row_type"), F.col("id").alias("seq"), F.sha2(
        F.col("id").cast("string"), 256).alias("x"))
    rows.coalesce(1).write.option("parquet.block.size", "200000").parquet(f"{folder}/in")
    seen = []
    for checkpoint, bound in (("a", "128m"), ("b", "50k")):
        spark.conf.set(name, bound)
        try:
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            jobs.drain(stream, lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())), f"{folder}/{checkpoint}")
            assert spark.conf.get(name) == bound
        finally:
            spark.conf.set(name, before)
    size = sum(f.stat().st_size for f in pathlib.Path(f"{folder}/in").glob("*.parquet"))
    assert seen[0][1] == seen[1][1] == 40_000 and size > 1_000_000
    assert seen[0][0] >= size // 100_000 and seen[1][0] >= size // 51_200


@pytest.mark.parametrize("setting, size", [("16m", 16 << 20), ("134217728b", 1 << 27), ("128MB", 1 << 27), ("7", 7), ("2g", 2 << 30)])
def test_sizes_of_settings(setting, size):
    assert byte_size(setting) == size


def test_fed_rows_are_not_computed_for_their_last_number(spark, folder):
    computed = spark.sparkContext.accumulator(0)

    def count(n: int) -> int:
        computed.add(1)
        return n

    rows = spark.range(30).select("id", F.udf(count, "long")("id").alias("n"))
    catalog._feed(rows, "id", f"{folder}/fed", lambda: None, last=29)
    assert sorted(r["n"] for r in spark.read.parquet(f"{folder}/fed").collect()) == list(range(30))
    assert computed.value == 30


def test_endless_instructions_need_no_join(spark, folder):
    """Every tenth nonce gets an expiry of 2^64 - 1 in the same pass, all else stays."""
    rows = spark.range(60).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id")).alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")
    sent = catalog._sent(spark, folder)
    endless = catalog._endless(sent)
    assert "Join" not in endless._jdf.queryExecution().optimizedPlan().toString()
    plain = {r["event_id"]: bytes(r["data"]) for r in sample_tables.raw_logs(sent).collect()}
    for r in endless.collect():
        was, now = plain[r["event_id"]], bytes(r["data"])
        assert now == (was[:32] + bytes(24) + b"\xff" * 8 + was[64:] if r["event_id"] % 10 == 0 else was)


def test_well_packed_events_are_dealt_by_their_rows(spark, folder, monkeypatch):
    spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(sample_tables, "FEW_BYTES", 10)
    monkeypatch.setattr(sample_tables, "ROWS_A_TASK", 100)
    dealt = sample_tables.table(spark, folder, "events")
    assert dealt.rdd.getNumPartitions() == 30 and dealt.count() == 3000


def test_shuffle_files_go_with_their_query(spark, folder):
    names = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]

    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    known = files()
    with frugal(spark):
        assert [spark.conf.get(n) for n in names] == ["true", str(16 << 20)]
        counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
        counted.write.parquet(f"{folder}/counted")
        late = time.time() + 20
        while files() - known and time.time() < late:   # deleted in the background
            time.sleep(0.1)
        assert not files() - known
        assert spark.read.parquet(f"{folder}/counted").count() == counted.count() == 10
    assert [spark.conf.get(n) for n in names] == before
