"""The live chain: headers, logs and retractions into log, state, feeds and delivery, through reorganisations.

One ``foreachBatch`` body takes all inputs of a micro-batch, so what a log means is decided by the
headers that came with it. A batch goes these ways:

1. Block rows. A header gives its own row and, by its parent hash, one for the height
   below; a log gives one where no header spoke; a retraction takes one back. What changed
   against the stored rows is the reorganisation, its lowest height less one the common ancestor.
2. Log. Logs that are not stored yet are appended, with rising arrival ids where the source has none.
3. State. Views, registry and control tables are partial rows by block bucket. Only logs
   whose block hash is the canonical one are folded. A reorganisation cuts the buckets above its ancestor
   off (a filter on partition columns) and folds these again from the log; older buckets are not read.
4. Feeds and delivery get what is newly canonical, and delivery the ancestor and the head.

An orphan's log that comes late, or again, is in the log at most: its hash is not the canonical one.
Every table is keyed by the batch id or by its own key, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logtide import schemas
from logtide.operators import control, decode, feeds, health, ingest, registry, reorg, views
from logtide.session import frugal, nothing, scratch, shuffles, side_by_side, sized
from logtide.sources.logs import rpc_block, rpc_log
from logtide.sources.raw_log import RawLog
from logtide.sources.tables import (
    BLOCKS_PER_BUCKET, BucketState, EventLog, MergeTable, VersionedTable, drop_versions, versions,
)
from logtide.streaming import jobs

#: How a block row came to be known; the arrival number of a row is four times its batch plus this.
BY_LOG, BY_CHILD, BY_HEADER = 0, 1, 2
#: Rows of a batch for one partition of its shuffles: some 70 MB as events in memory.
ROWS_A_TASK = 100_000
#: What :meth:`LiveChain._touched` calls logs with and without an id of their source.
_LOGS = {"named", "nameless"}

RETRACTED = T.StructType([T.StructField("chain_id", T.IntegerType()), T.StructField("block_number", T.LongType()),
                          T.StructField("block_hash", T.BinaryType())])
_INPUTS = {"header": schemas.BLOCK, "log": schemas.RAW_LOG, "retracted": RETRACTED}
_BLOCK = T.StructType([*schemas.BLOCK.fields, T.StructField("seq", T.LongType())])
_CUT = T.StructType([T.StructField("chain_id", T.IntegerType()), T.StructField("bucket", T.LongType())])
_HIGH = T.StructType([T.StructField("high", T.LongType())])
ENVELOPE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("chain_id", T.IntegerType()),
                         T.StructField("payload", T.StringType())])
REJECT = T.StructType([*ENVELOPE.fields[:2], T.StructField("contract", T.BinaryType()), T.StructField("kind", T.StringType()),
                       T.StructField("block_number", T.LongType())])
REORG = T.StructType([
    T.StructField("chain_id", T.IntegerType()), T.StructField("ancestor", T.LongType()), T.StructField("head", T.LongType()),
    T.StructField("blocks", T.LongType()), T.StructField("removed_rows", T.LongType()), T.StructField("status", T.StringType())])


def inputs(logs: DataFrame | None = None, headers: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """The job's one input out of raw logs, headers and retractions; frames or streams."""
    given = {"log": logs, "header": headers, "retracted": retracted}
    parts = [
        rows.select(*[(F.struct(*kind.fieldNames()) if n == name else F.lit(None)).cast(kind).alias(n) for n, kind in _INPUTS.items()])
        for name, rows in given.items() if rows is not None]
    return reduce(DataFrame.unionByName, parts)


def rpc_inputs(rows: DataFrame, chain_id: int) -> DataFrame:
    """The job's one input out of node responses, logs and retractions; each line is read once."""
    gone = F.coalesce("removed", F.lit(False))
    given = {"log": F.when(~gone, F.struct(*rpc_log(chain_id))), "retracted": F.when(gone, F.struct(*rpc_block(chain_id)))}
    return rows.select(*[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _INPUTS.items()])


class LiveChain:
    """All live state of some chains under one folder.

    ``view_specs`` may hold views of the user's own. With ``seed`` (watched rows) only logs of watched contracts
    are kept; a cluster minted in a batch is watched from then on, and what it emitted before is
    read from ``backlog``, the table of raw logs so far, by its own buckets. ``delivery`` gets the newly canonical instructions in nonce order.
    A reorganisation deeper than ``finality_depth`` is carried out and recorded as such.
    """

    def __init__(self, spark: SparkSession, root: str, specs: Iterable[decode.EventSpec] = decode.DEFAULT_SPECS,
                 view_specs: Iterable[views.StateView] = tuple(views.VIEWS.values()), seed: DataFrame | None = None,
                 backlog: RawLog | None = None, delivery: Callable[[DataFrame, int], None] | None = None,
                 finality_depth: int = control.CONFIRMATIONS, bucket_blocks: int = BLOCKS_PER_BUCKET):
        self.spark, self.root, self.seed, self.backlog, self.delivery = spark, root, seed, backlog, delivery
        self.specs, self.finality_depth, self.bucket_blocks = decode.registry(specs), finality_depth, bucket_blocks
        self.view_specs = {view.name: view for view in view_specs}
        schema = jobs.event_type(self.specs)
        empty = spark.createDataFrame([], schema)
        self.log = EventLog(spark, f"{root}/events", schema, bucket_blocks)
        self.block_table = MergeTable(spark, f"{root}/blocks", ingest.latest_blocks, _BLOCK)
        self.high, self.cut_table = VersionedTable(spark, f"{root}/high", _HIGH), f"{root}/cuts"
        state = lambda name, fold, merge, kind: BucketState(spark, f"{root}/{name}", fold, merge, kind)
        self.views = {name: state(f"views/{name}", view.partial, view.merge, view.partial(empty).schema)
                      for name, view in self.view_specs.items()}
        self.watched = state("watched", registry.discover, lambda rows: ingest.first_write(
            rows, registry.KEY, ["from_block", "parent"]), schemas.WATCHED)
        self.instructions = state("instructions", control.add_instructions, control.add_instructions, schemas.INSTRUCTION)
        self.acks = state("acks", control.add_acks, control.add_acks, schemas.ACK)

    # --- reads ---------------------------------------------------------------

    def blocks(self) -> DataFrame:
        """Canonical block rows; the time is 0 until a header gives it."""
        return self.block_table.read().where(F.col("hash") != F.lit(ingest.ZERO_HASH)).drop("seq")

    def events(self) -> DataFrame:
        """The whole log, ``removed`` set on what lies in blocks that are not canonical."""
        stored = self.log.read()
        return reorg.mark_removed(stored, reorg.orphan_blocks(stored, self.block_table.read()))

    def cuts(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(batch, chain, first bucket) of the reorganisations since the last compaction."""
        return [(v, r["chain_id"], r["bucket"]) for v in versions(self.spark, self.cut_table)
                if before is None or v < before
                for r in self.spark.read.schema(_CUT).parquet(f"{self.cut_table}/v={v}").collect()]

    def state(self, table: BucketState, before: int | None = None, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return table.read(self.cuts(before), before, only)

    def view(self, name: str) -> DataFrame:
        """A view's answer from its kept state."""
        view = self.view_specs[name]
        blocks = sized(self.blocks(), "view-blocks") if view.needs_blocks else self.blocks()  # so they join without a shuffle of the view
        return view.finish(self.state(self.views[name]), blocks)

    def reorgs(self) -> DataFrame:
        """What was rolled back, one row for each chain and batch ``v``."""
        return self._written("reorgs", REORG)

    def health(self, now: int) -> DataFrame:
        """Counters of all batches so far with head, finality and lag per chain; reads no log."""
        return health.from_counts(self._written("health", health.COUNTS), self.reorgs(), self.blocks(), self.finality_depth, now)

    def feed(self) -> DataFrame:
        """Change envelopes with the stored ids, by batch ``v``."""
        return self._written("feed", ENVELOPE)

    def control_feed(self, name: str) -> DataFrame:
        return self._written(f"control_feed/{name}", ENVELOPE)

    def control_rejects(self) -> DataFrame:
        """Control rows whose values do not fit storage."""
        return self._written("control_rejects/instruction", REJECT).unionByName(self._written("control_rejects/ack", REJECT))

    def _written(self, name: str, schema: T.StructType) -> DataFrame:
        folder, schema = f"{self.root}/{name}", T.StructType([*schema.fields, T.StructField("v", T.LongType())])
        known = versions(self.spark, folder)
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", folder).schema(schema).parquet(*[f"{folder}/v={v}" for v in known])

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={batch_id}")

    # --- a batch -------------------------------------------------------------

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(self.spark), frugal(self.spark, batch.sparkSession):
            # written, not cached: a cached batch fills the executors' memory and then, wider than its file, their disks
            batch = sized(batch.withColumn("turn", F.monotonically_increasing_id()), "batch")
            rows = batch.count()  # footers only
            # forks of equal length are decided by arrival, which files that are read again do not keep
            in_turn = {"header": batch.where(F.col("header").isNotNull()).orderBy("turn")}
            with shuffles(-(-rows // ROWS_A_TASK), self.spark, batch.sparkSession):
                self._batch(batch_id, rows, *[in_turn.get(n, batch.where(F.col(n).isNotNull())).select(f"{n}.*")
                                              for n in ("header", "log", "retracted")])
        if batch_id % jobs.COMPACT_EVERY == jobs.COMPACT_EVERY - 1:
            self.compact(batch_id)

    def _batch(self, batch_id: int, rows: int, headers: DataFrame, raw: DataFrame, retracted: DataFrame) -> None:
        good, rejects = decode.split_rejects(self._admitted(raw, batch_id))
        arrived = decode.normalise(good)
        held, touched = self._touched(arrived, headers, retracted)
        met = self.log.near(arrived, touched).count() if held & _LOGS else 0  # footers only
        with shuffles(-(-(rows + met) // ROWS_A_TASK), self.spark, arrived.sparkSession):
            self._apply(batch_id, headers, retracted, arrived, rejects, held, touched, met > 0)

    def _apply(self, batch_id: int, headers: DataFrame, retracted: DataFrame, arrived: DataFrame, rejects: DataFrame,
               held: set[str], touched: list[tuple[int, int]], met: bool) -> None:
        """A batch's logs into log, state, feeds and delivery; ``met``: the log has rows in the buckets that they touch.

        Logs are decoded once for the log. What follows reads them there, the columns that it needs.
        """
        once = ingest.append_events(arrived).persist(StorageLevel.DISK_ONLY)
        fresh = self._fresh(batch_id, once, touched if met else [])
        if not met:
            once.unpersist()
        evidence, changed = self._settle(batch_id, headers if "header" in held else None, fresh,
                                         retracted if "retracted" in held else None, touched)
        columns = [c for c in self.log.schema.fieldNames() if c != "block_bucket"]
        if held & _LOGS:
            self._append(batch_id, fresh, touched, "nameless" in held)
        if not held & _LOGS:
            events = nothing(self.spark, self.log.schema).select(columns)
        elif met:
            ids = self.log.near(once, touched).select(*schemas.EVENT_KEY, "event_id")
            again = ids.join(once.drop("event_id"), schemas.EVENT_KEY).select(once.columns)
            events = decode.with_payload(again, self.specs).select(columns).persist(StorageLevel.DISK_ONLY)
        else:  # all were new, and are all that the log has in these buckets
            events = self.log.near(once, touched).select(columns)
        ancestors = {r["chain_id"]: r["ancestor"] for r in changed.groupBy("chain_id").agg(
            (F.min("number") - 1).alias("ancestor")).collect()}  # a row for each chain
        self.block_table.put(batch_id, evidence)
        if ancestors:
            self._write("cuts", batch_id, self.spark.createDataFrame(
                [(c, (a + 1) // self.bucket_blocks) for c, a in ancestors.items()], _CUT).coalesce(1))
        else:
            drop_versions(self.spark, self.cut_table, [batch_id])
        again_rows = self.log.read().where(self._above(ancestors)).count() if ancestors else 0  # footers only
        with shuffles(-(-again_rows // ROWS_A_TASK), self.spark, events.sparkSession):
            again, news = self._canonical(events, ancestors, changed, touched)
            # what has no rows in a batch costs it nothing
            kinds = {r["kind"] for r in again.select("kind").distinct().collect()}
            writes = [lambda: self._write("feed", batch_id, feeds.change_feed(news)),
                      lambda: self._write("rejects", batch_id, rejects),
                      lambda: self._write("health", batch_id, health.batch_counts(arrived, fresh)),
                      lambda: self._roll_back(batch_id, ancestors, changed)]
            writes += [lambda t=table, own=view.kinds: t.put(batch_id, again.where(F.col("kind").isin(*own)), self.bucket_blocks)
                       for view, table in ((self.view_specs[name], t) for name, t in self.views.items()) if kinds & set(view.kinds)]
            if "ClusterDeployed" in kinds:
                writes.append(lambda: self.watched.put(batch_id, again, self.bucket_blocks))
            if "ControlAck" in kinds:
                writes.append(lambda: self._control(batch_id, again, news, ancestors, "ack", self.acks))
            sent = self.spark.createDataFrame([], schemas.INSTRUCTION)
            if "ControlInstructionBroadcast" in kinds:
                writes.append(lambda: self._control(batch_id, again, news, ancestors, "instruction", self.instructions))
                sent = side_by_side(writes)[-1]
            else:
                side_by_side(writes)
        if self.delivery is not None:
            self.delivery(self._delivered(sent, headers, ancestors), batch_id)
        if met:
            for kept in (events, once):
                kept.unpersist()

    def _touched(self, events: DataFrame, headers: DataFrame, retracted: DataFrame) -> tuple[set[str], list[tuple[int, int]]]:
        """(what a batch holds, (chain, bucket) it has to do with); the latter's number is bounded by the chains' heights."""
        bucket = lambda n: F.floor(n / self.bucket_blocks).alias("bucket")
        named = F.when(F.col("event_id").isNull(), F.lit("nameless")).otherwise(F.lit("named"))
        rows = events.select(named.alias("what"), "chain_id", bucket(F.col("block_number"))).union(headers.select(
            F.lit("header"), "chain_id", F.explode(F.array(bucket(F.col("number")), bucket(F.greatest(F.col("number") - 1, F.lit(0))))))).union(
            retracted.select(F.lit("retracted"), "chain_id", bucket(F.col("block_number"))))
        found = rows.distinct().collect()
        return {r["what"] for r in found}, sorted({(r["chain_id"], r["bucket"]) for r in found})

    def _fresh(self, batch_id: int, events: DataFrame, touched: list[tuple[int, int]]) -> DataFrame:
        """The batch's logs that were not stored before it; a batch that is run again reads its first answer."""
        folder, stored = f"{self.root}/fresh", self.log.near(events, touched).select(*schemas.EVENT_KEY)
        done = versions(self.spark, folder)
        if batch_id not in done:
            self._write("fresh", batch_id, events.join(stored, schemas.EVENT_KEY, "left_anti"))
            drop_versions(self.spark, folder, [v for v in done if v < batch_id])
        return self.spark.read.schema(events.schema).parquet(f"{folder}/v={batch_id}")

    def _heights(self, touched: Iterable[tuple[int, int]], from_bucket: dict[int, int] | None = None) -> Column:
        """Rows of the block table in some buckets, or from a bucket on; reaches the scan."""
        size, wanted = self.bucket_blocks, F.lit(False)
        for chain, bucket in touched:
            wanted |= (F.col("chain_id") == chain) & F.col("number").between(bucket * size, (bucket + 1) * size - 1)
        for chain, bucket in (from_bucket or {}).items():
            wanted |= (F.col("chain_id") == chain) & (F.col("number") >= bucket * size)
        return wanted

    def _settle(self, batch_id: int, headers: DataFrame | None, fresh: DataFrame, retracted: DataFrame | None,
                touched: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        """(block rows a batch adds, heights whose hash they change: chain_id, number, was, hash).

        Headers decide over what a child says of its parent, both over logs. A log speaks for its block only
        when it is new itself and no header did; so neither a repeated nor a late log of an orphan moves a row.
        """
        on = ["chain_id", "number"]
        known = self.block_table.read(before=batch_id, where=self._heights(touched))
        stored = known.select(*on, F.col("hash").alias("was"), "seq").persist()
        blank = [F.lit(ingest.ZERO_HASH).alias("parent_hash"), F.lit(0).cast("long").alias("block_ts")]
        row = lambda rows, how, *rest: rows.select(*on, "hash", *rest, F.lit(4 * batch_id + how).cast("long").alias("seq"))
        by_logs = ingest.blocks_from_logs(fresh).drop("seq").join(stored, on, "left").where(
            F.col("seq").isNull() | (F.col("seq") % 4 == BY_LOG))
        rows = [row(by_logs, BY_LOG, *blank)]
        if headers is not None:
            chosen = reorg.choose_forks(headers)
            parents = chosen.where((F.col("number") > 0) & (F.col("parent_hash") != F.lit(ingest.ZERO_HASH))).select(
                "chain_id", (F.col("number") - 1).alias("number"), F.col("parent_hash").alias("hash")).distinct()
            claims = parents.join(chosen.select(*on), on, "left_anti").join(stored, on, "left").where(
                F.col("was").isNull() | (F.col("was") != F.col("hash")))
            rows += [row(chosen, BY_HEADER, "parent_hash", "block_ts"), row(claims, BY_CHILD, *blank)]
        if retracted is not None:
            taken = retracted.select("chain_id", F.col("block_number").alias("number"), F.col("block_hash").alias("was")).distinct().join(
                stored.drop("seq"), [*on, "was"], "left_semi").select(*on, F.lit(ingest.ZERO_HASH).alias("hash"))
            rows.append(row(taken, BY_LOG, *blank))
        evidence = sized(reduce(DataFrame.unionByName, rows), "evidence")
        now = ingest.latest_blocks(known.unionByName(evidence)).select(*on, "hash")
        changed = sized(stored.join(now, on).where(F.col("was") != F.col("hash")).select(*on, "was", "hash"), "changed")
        stored.unpersist()
        return evidence, changed

    def _append(self, batch_id: int, fresh: DataFrame, touched: list[tuple[int, int]], nameless: bool) -> None:
        """New logs into the log; those without an id of their source get the next arrival ids.

        Tasks number their own rows, the counts of the tasks give each its start, and the high-water mark of
        the batches before gives the first. A batch that is run again finds its rows stored, with their ids.
        """
        near = self.log.near(fresh, touched)
        fresh = fresh.join(near.select(*schemas.EVENT_KEY), schemas.EVENT_KEY, "left_anti").select(fresh.columns)
        mark = self.high.read(before=batch_id).first()
        end = 0 if mark is None else mark["high"]
        named = fresh.where(F.col("event_id").isNotNull())
        payload = lambda rows: decode.with_payload(rows, self.specs)
        if nameless:
            # rows that a first run had stored already took ids beyond the mark
            end = max(end, near.agg(F.max("event_id")).first()[0] or 0)
            order = ["chain_id", "block_number", "log_index", "block_hash", "contract"]
            with scratch(self.spark):
                lined = sized(fresh.where(F.col("event_id").isNull()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
                    "slot", F.monotonically_increasing_id()), "lined")
                part, offsets = F.shiftright("slot", 33), []
                for r in sorted(lined.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each task
                    offsets.append((r["part"], end))
                    end += r["n"]
                starts = sized(self.spark.createDataFrame(offsets, "part long, first long").coalesce(1), "starts")
                numbered = lined.withColumn("part", part).join(starts, "part").withColumn(
                    "event_id", F.col("first") + F.col("slot").bitwiseAND((1 << 33) - 1) + 1)
                self.log.append(named.unionByName(numbered.select(fresh.columns)), payload)
        else:
            self.log.append(named, payload)
        own = self.log.near(fresh, touched).agg(F.max("event_id")).first()[0] or 0
        self.high.write(batch_id, self.spark.createDataFrame([(max(end, own),)], _HIGH).coalesce(1))

    def _above(self, ancestors: dict[int, int]) -> Column:
        """Rows of the log in the buckets that a reorganisation cuts off; partitions only."""
        return reduce(Column.__or__, [(F.col("chain_id") == c) & (F.col("block_bucket") >= (a + 1) // self.bucket_blocks)
                                      for c, a in ancestors.items()])

    def _canonical(self, events: DataFrame, ancestors: dict[int, int], changed: DataFrame,
                   touched: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        """(canonical rows to fold, canonical rows that are new to readers).

        To fold: the batch's, and all rows of the buckets above an ancestor. New to readers: the batch's, and
        those of blocks that became canonical.
        """
        cut = {c: (a + 1) // self.bucket_blocks for c, a in ancestors.items()}
        bucket, redone = F.floor(F.col("block_number") / self.bucket_blocks), F.lit(False)
        for chain, first in cut.items():
            redone |= (F.col("chain_id") == chain) & (bucket >= first)
        rows = events.where(~redone)
        for chain, first in cut.items():
            rows = rows.unionByName(self.log.read().where(
                (F.col("chain_id") == chain) & (F.col("block_bucket") >= first)).select(events.columns))
        truth = self.block_table.read(where=self._heights(touched, cut)).select(
            "chain_id", F.col("number").alias("block_number"), F.col("hash").alias("block_hash"))
        on = ["chain_id", "block_number", "block_hash"]
        wrong = sized(rows.select(*on).distinct().join(truth, on, "left_anti"), "not-canonical")
        rows = reorg.survivors(rows, wrong)
        news = reorg.survivors(events, wrong)
        if cut:
            turned = changed.select("chain_id", F.col("number").alias("block_number"), F.col("hash").alias("block_hash"))
            back = rows.join(turned, on, "left_semi").join(events.select(*schemas.EVENT_KEY), schemas.EVENT_KEY, "left_anti")
            news = news.unionByName(back)
        return rows, news

    def _control(self, batch_id: int, again: DataFrame, news: DataFrame, ancestors: dict[int, int], name: str,
                 table: BucketState) -> DataFrame:
        """A control table, its rejects and its feed for a batch; returns the rows that newly hold their key.

        Above an ancestor readers start anew, so there every holder counts as new.
        """
        typed, keys = {"instruction": (control.instructions, control.INSTRUCTION_KEY), "ack": (control.acks, control.ACK_KEY)}[name]
        above = F.lit(False)
        for chain, ancestor in ancestors.items():
            above |= (F.col("chain_id") == chain) & (F.col("block_number") > ancestor)
        rows, (arrived, bad) = typed(again)[0], typed(news)
        table.put(batch_id, rows, self.bucket_blocks)
        met = sized(arrived.select(*keys).union(rows.where(above).select(*keys)).distinct(), "keys")
        only = lambda r: r.join(met, keys, "left_semi")
        before = self.state(table, batch_id, only).where(~above).select("chain_id", "row_id")
        fresh = sized(self.state(table, only=only).join(before, ["chain_id", "row_id"], "left_anti"), name)
        self._write(f"control_feed/{name}", batch_id, feeds.control_feed(fresh, name))
        self._write(f"control_rejects/{name}", batch_id, bad.select("event_id", "chain_id", "contract", "kind", "block_number"))
        return fresh

    def _roll_back(self, batch_id: int, ancestors: dict[int, int], changed: DataFrame) -> None:
        """What a batch took back, for each chain."""
        if not ancestors:
            drop_versions(self.spark, f"{self.root}/reorgs", [batch_id])
            return
        cut = {c: (a + 1) // self.bucket_blocks for c, a in ancestors.items()}
        gone = changed.select("chain_id", F.col("number").alias("block_number"), F.col("was").alias("block_hash"))
        removed = self.log.read().where(self._above(ancestors)).join(gone, ["chain_id", "block_number", "block_hash"], "left_semi").groupBy(
            "chain_id").agg(F.count("*").alias("removed_rows"))
        heads = self.block_table.read(where=self._heights([], cut)).groupBy("chain_id").agg(F.max("number").alias("head"))
        counted = changed.groupBy("chain_id").agg((F.min("number") - 1).alias("ancestor"), F.count("*").alias("blocks"))
        self._write("reorgs", batch_id, counted.join(heads, "chain_id").join(removed, "chain_id", "left").select(
            "chain_id", "ancestor", "head", "blocks", F.coalesce("removed_rows", F.lit(0)).alias("removed_rows"),
            F.when(F.col("head") - F.col("ancestor") > self.finality_depth, F.lit("DEEPER_THAN_FINALITY")).otherwise(F.lit("OK")).alias("status")))

    def _delivered(self, sent: DataFrame, headers: DataFrame, ancestors: dict[int, int]) -> DataFrame:
        """A batch as delivery reads it: ancestors first, then instructions, then heads."""
        columns = jobs.ORDERER_INPUT.fieldNames()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.ORDERER_INPUT.fields
                 if f.name not in ("row_type", "seq", "chain_id", "block_number")]
        mark = lambda rows, kind, seq: rows.select(
            F.lit(kind).alias("row_type"), F.lit(seq).cast("long").alias("seq"), "chain_id", "block_number", *blank).select(columns)
        back = self.spark.createDataFrame(list(ancestors.items()), "chain_id int, block_number long")
        heads = headers.groupBy("chain_id").agg(F.max("number").alias("block_number"))
        rows = sent.withColumns({"row_type": F.lit(jobs.INSTRUCTION_ROW), "seq": F.lit(1).cast("long")}).select(columns)
        return mark(back, jobs.REORG_ROW, 0).unionByName(rows).unionByName(mark(heads, jobs.HEAD_ROW, 2))

    def _admitted(self, raw: DataFrame, batch_id: int) -> DataFrame:
        """Logs of watched contracts, with all that newly found ones emitted since they were minted."""
        if self.seed is None:
            return raw
        watched = self.seed.unionByName(self.state(self.watched, batch_id)).select(*registry.KEY).distinct()
        mine = jobs.watched_only(raw, watched)
        minted = registry.discover(decode.decode_logs(mine, self.specs)[0])
        found = sized(minted.join(watched, registry.KEY, "left_anti"), "found")
        if found.isEmpty():
            return mine
        mine = mine.unionByName(jobs.watched_only(raw, found))
        return mine if self.backlog is None else sized(mine.unionByName(self.backlog.since(found).select(raw.columns)), "admitted")

    def compact(self, before: int) -> None:
        """Fold finished batches of every table into new bases; later cuts stay."""
        cuts = self.cuts(before)
        for table in (*self.views.values(), self.watched, self.instructions, self.acks):
            table.compact(cuts, before)
        self.block_table.compact(before)
        drop_versions(self.spark, self.cut_table, sorted({v for v, _, _ in cuts}))
