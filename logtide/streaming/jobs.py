"""Micro-batch jobs: blocks with reorg signals, and ordered delivery; :mod:`live` has the chain's state.

Each job is a ``foreachBatch`` body. A body may run twice for one batch id;
every write is keyed by the batch id or guarded by the table's own key, so the
second run changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logtide import schemas
from logtide.operators import control, decode, ingest, orderer, reorg
from logtide.schemas import EVENT_KEY
from logtide.session import byte_size, scratch, sized
from logtide.sources.tables import DeltaTable, MergeTable, VersionedTable

COMPACT_EVERY = 20
#: Of files for one task of a batch: some 200,000 stored logs, which are 150 MB or so in memory.
SPLIT_BYTES = 16 << 20


def run(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str,
        available_now: bool = True, interval: str = "5 seconds"):
    """Start a job; with ``available_now`` it drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def drain(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a job over a growing table of files to the end of what is there, in splits of ``SPLIT_BYTES`` at most.

    Logs grow several times when a batch keeps them in memory, so Spark's own splits, as large as a core's share of the
    files, would make tasks as large as the batch. The splits are the session's setting, which it gets back after.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    if byte_size(before) > SPLIT_BYTES:
        conf.set(name, str(SPLIT_BYTES))
    try:
        run(stream, body, checkpoint).awaitTermination()
    finally:
        conf.set(name, before)


def event_type(specs: Iterable[decode.EventSpec] = decode.DEFAULT_SPECS) -> T.StructType:
    """Columns of decoded events."""
    spark = SparkSession.active()
    return decode.with_payload(
        decode.normalise(spark.createDataFrame([], schemas.RAW_LOG)), specs).schema


def watched_only(logs: DataFrame, watched: DataFrame) -> DataFrame:
    """Stream-static guard: logs of watched addresses."""
    return logs.join(watched.select("chain_id", "address"), ["chain_id", "address"], "left_semi")


def logs_of_minted(logs: DataFrame, deployed: DataFrame, hold_blocks: int) -> DataFrame:
    """Logs of minted clusters from their deployment on, whichever of the two streams is ahead.

    A stream-stream join holds logs of unknown contracts until their deployment comes; nothing is read again for it.
    Block numbers are its event time: a log is held until both streams are ``hold_blocks`` past it, a deployment
    (a few bytes) for good. ``deployed`` has (chain_id, address, from_block); of repeated ones the first to arrive counts.
    """
    # the first watermark is second 0, at which block 0 would be late
    at, hold = lambda c: F.timestamp_seconds(F.col(c) + 1), f"{hold_blocks} seconds"
    minted = deployed.select("chain_id", "address", at("from_block").alias("_minted")).withWatermark("_minted", hold).dropDuplicates(
        ["chain_id", "address"]).alias("d")
    held = logs.withColumn("_at", at("block_number")).withWatermark("_at", hold).alias("l")
    mine = ((F.col("l.chain_id") == F.col("d.chain_id")) & (F.col("l.address") == F.col("d.address"))
            & (F.col("_at") >= F.col("_minted")))
    return held.join(minted, mine).select([F.col(f"l.{c}") for c in logs.columns])


def each_once(deliveries: DataFrame) -> DataFrame:
    """Overlapping deliveries reduced to one row per log, however late the first one comes.

    A log is known by its chain, contract, block hash and index, so the replacement that a fork puts
    at an orphan's position is a log of its own. A watermark would discard first deliveries of old
    events, which is what a backfill consists of. Keys are kept for good instead, in
    the RocksDB state store, spread over all state partitions.
    """
    return deliveries.dropDuplicates(EVENT_KEY)


class BlockJob:
    """Headers alone into the block table, with the reorg signals each batch raises.

    A batch is compared with the stored chain and with itself, so a fork whose
    both sides arrive together is signalled too. Of branches in one batch the
    one that reaches furthest is stored, see :func:`reorg.choose_forks`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        schema = T.StructType(schemas.BLOCK.fields + [T.StructField("seq", T.LongType())])
        self.table = MergeTable(spark, f"{root}/blocks", ingest.latest_blocks, schema)

    def __call__(self, headers: DataFrame, batch_id: int) -> None:
        headers = headers.persist()
        row = lambda frame, last: frame.select(*schemas.BLOCK.fieldNames(), F.lit(2 * batch_id + last).cast("long").alias("seq"))
        rows = row(headers, 0).unionByName(row(reorg.choose_forks(headers), 1))
        known = self.table.read(before=batch_id).unionByName(rows)
        reorg.detect(headers, known).write.mode("overwrite").parquet(f"{self.root}/signals/v={batch_id}")
        self.table.put(batch_id, ingest.latest_blocks(rows))
        headers.unpersist()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.table.compact(before=batch_id)

    def blocks(self) -> DataFrame:
        return self.table.read().drop("seq")

    def signals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/signals/v=*")


# --- ordered delivery ------------------------------------------------------

# The orderer reads one stream of three row types. ``seq`` is the arrival
# number; ``block_number`` holds the head of a head row and the ancestor of a
# reorg row.
INSTRUCTION_ROW, HEAD_ROW, REORG_ROW = "instruction", "head", "reorg"
ORDERER_INPUT = T.StructType(
    [T.StructField("row_type", T.StringType()), T.StructField("seq", T.LongType())]
    + schemas.INSTRUCTION.fields)

_WAITING = T.StructType(schemas.INSTRUCTION.fields + [T.StructField("buffered_at", T.LongType())])
_CURSOR = T.StructType([
    T.StructField("chain_id", T.IntegerType()), T.StructField("cluster", T.BinaryType()),
    T.StructField("initial", T.LongType())])
_HEADS = T.StructType([T.StructField("chain_id", T.IntegerType()), T.StructField("head", T.LongType())])


def _furthest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain_id", "cluster").agg(F.max("initial").alias("initial"))


class OrderedDelivery:
    """Strict nonce order per cluster over a stream.

    The state between batches is four tables: rows still waiting, holes, the cursor
    per cluster (all below it is delivered), and the head per chain. A batch is the batch orderer over
    waiting and arrived rows, so both forms agree by construction and a very
    busy cluster spreads over all tasks instead of living in one state partition. What waits and what
    is open is kept as changes: a batch writes the rows it adds and tombstones for those it delivers.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int],
                 initial: DataFrame | None = None, confirmations: int = control.CONFIRMATIONS,
                 max_buffer: int | None = None, max_age: int | None = None):
        self.spark, self.root, self.clock = spark, root, clock
        self.initial, self.confirmations = initial, confirmations
        self.max_buffer = orderer.MAX_BUFFER if max_buffer is None else max_buffer
        self.max_age = orderer.MAX_BUFFER_AGE if max_age is None else max_age
        self.waiting = DeltaTable(spark, f"{root}/waiting", _WAITING, control.INSTRUCTION_KEY)
        self.heads = VersionedTable(spark, f"{root}/heads", _HEADS)
        self.holes = DeltaTable(spark, f"{root}/holes", schemas.HOLE, control.HOLE_KEY)
        self.cursors = MergeTable(spark, f"{root}/cursors", _furthest, _CURSOR)

    def _rows(self, batch: DataFrame, held: DataFrame, now: int) -> DataFrame:
        """Waiting and arrived instructions, less those a reorg took back, first write per nonce; ``seq`` -1 has waited."""
        held = held.withColumn("seq", F.lit(-1).cast("long"))
        arrived = batch.where((F.col("row_type") == INSTRUCTION_ROW) & ~F.col("removed")).drop(
            "row_type").withColumn("buffered_at", F.lit(now).cast("long"))
        rows = held.unionByName(arrived).alias("r")
        cuts = sized(batch.where(F.col("row_type") == REORG_ROW).select(
            F.col("chain_id"), F.col("seq"), F.col("block_number").alias("ancestor")), "cuts").alias("c")
        taken_back = ((F.col("r.chain_id") == F.col("c.chain_id")) & (F.col("c.seq") > F.col("r.seq"))
                      & (F.col("r.block_number") > F.col("c.ancestor")))
        return ingest.first_write(rows.join(cuts, taken_back, "left_anti"), control.INSTRUCTION_KEY, ["seq"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(self.spark):
            self._deliver(batch, batch_id)

    def _deliver(self, batch: DataFrame, batch_id: int) -> None:
        now = self.clock()
        batch = batch.persist()
        heads = (
            self.heads.read(before=batch_id)
            .unionByName(batch.where(F.col("row_type") == HEAD_ROW).select(
                "chain_id", F.col("block_number").alias("head")))
            .groupBy("chain_id").agg(F.max("head").alias("head"))
        )
        self.heads.write(batch_id, heads)
        heads = self.heads.read(before=batch_id + 1)
        cursors = self.cursors.read(before=batch_id)
        if self.initial is not None:
            cursors = _furthest(cursors.unionByName(self.initial.select(_CURSOR.fieldNames())))
        held = self.waiting.read(before=batch_id)
        ordered = orderer.order(self._rows(batch, held, now), heads, cursors, self.confirmations, headless_final=False).persist()
        sent = ordered.where(F.col("outcome") == orderer.DISPATCHED)
        order = ["chain_id", "cluster", "nonce"]
        (
            sent.select(*_WAITING.fieldNames()).repartitionByRange(*order).sortWithinPartitions(*order)
            .write.mode("overwrite").parquet(f"{self.root}/dispatched/v={batch_id}")
        )
        stalled = orderer.find_holes(ordered, now, self.max_buffer, self.max_age).join(
            sent.select("chain_id", "cluster").distinct(), ["chain_id", "cluster"], "left_anti")
        open_before = self.holes.read(before=batch_id)
        closed = control.resolve_holes(open_before, sent, now).drop("changed")
        now_open = control.record_holes(closed, stalled, now)
        same = [now_open[c].eqNullSafe(open_before[c]) for c in schemas.HOLE.fieldNames()]
        self.holes.put(batch_id, now_open.join(open_before, same, "left_anti"))
        waits = ordered.where(F.col("outcome").isin(orderer.AWAITING, orderer.NOT_FINAL))
        done = held.select(*control.INSTRUCTION_KEY).join(waits.select(*control.INSTRUCTION_KEY), control.INSTRUCTION_KEY, "left_anti")
        self.waiting.put(batch_id, waits.where(F.col("seq") >= 0), done)
        self.cursors.put(batch_id, sent.groupBy("chain_id", "cluster").agg(
            F.max("next_expected").alias("initial")))
        ordered.unpersist()
        batch.unpersist()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            for table in (self.cursors, self.waiting, self.holes):
                table.compact(before=batch_id)

    def dispatched(self) -> DataFrame:
        """Everything delivered so far with its batch number ``v``; nonce order within (cluster, v)."""
        return self.spark.read.option("basePath", f"{self.root}/dispatched").parquet(
            f"{self.root}/dispatched/v=*")
