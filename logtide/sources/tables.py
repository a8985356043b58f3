"""Parquet layout of the event log, and versioned small tables.

Spark has no MERGE on parquet, so each table takes the form its writes allow:
the event log only ever grows; state that changes in place is written as a new
numbered version, or as mergeable partial rows (:class:`MergeTable`). A
version number is the micro-batch id, so a retried batch reads what came before
it and rewrites its own version only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logtide.session import nothing

BLOCKS_PER_BUCKET = 10_000


# --- folders ---------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the completely written versions under ``root``, ascending."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v="):
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if fs.exists(done):
                found.append(int(name[2:]))
    return sorted(found)


def drop_versions(spark: SparkSession, root: str, numbers: list[int]) -> None:
    for number in numbers:
        fs, path = _fs(spark, f"{root}/v={number}")
        fs.delete(path, True)


# --- event log -------------------------------------------------------------

class EventLog:
    """Append-only events, partitioned by chain and block bucket.

    Inside a bucket rows are range-split and sorted by contract and block: one
    contract's rows sit in few row groups, and a contract that fills a bucket
    still spreads over many files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket_blocks: int = BLOCKS_PER_BUCKET):
        self.spark, self.path, self.bucket_blocks = spark, path, bucket_blocks
        self.schema = T.StructType([f for f in schema.fields if f.name != "block_bucket"]).add(
            "block_bucket", "long")

    def exists(self) -> bool:
        fs, path = _fs(self.spark, self.path)
        return fs.exists(path)

    def read(self) -> DataFrame:
        if not self.exists():
            return nothing(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def near(self, batch: DataFrame, touched: list[tuple[int, int]] | None = None) -> DataFrame:
        """Stored rows in the buckets a batch touches, (chain, bucket), which are looked up where not given.

        The batch's distinct buckets prune partitions, so one old redelivered
        log costs its own bucket, not all between. A bucket is ``bucket_blocks``
        blocks: what reaches the driver is bounded by the chains' heights.
        """
        if touched is None:
            bucket = F.floor(F.col("block_number") / self.bucket_blocks).alias("bucket")
            touched = [tuple(r) for r in batch.select("chain_id", bucket).distinct().collect()]
        wanted = F.lit(False)
        for chain in sorted({c for c, _ in touched}):
            wanted |= (F.col("chain_id") == chain) & F.col("block_bucket").isin([b for c, b in touched if c == chain])
        return self.read().where(wanted)

    def append(self, rows: DataFrame, widened: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """``rows`` into the log; ``widened`` adds columns, which the shuffle then need not carry."""
        order = ["chain_id", "block_bucket", "contract", "block_number", "log_index"]
        dealt = rows.withColumn("block_bucket", F.floor(F.col("block_number") / self.bucket_blocks)).repartitionByRange(*order)
        (
            widened(dealt).sortWithinPartitions(*order)
            .write.mode("append").partitionBy("chain_id", "block_bucket").parquet(self.path)
        )


# --- versioned table -------------------------------------------------------

class VersionedTable:
    """A small table rewritten per batch; readers of batch n see the version before n."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root, schema

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in versions(self.spark, self.root) if before is None or v < before]
        if not known:
            return nothing(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={known[-1]}")

    def write(self, version: int, rows: DataFrame, keep: int = 3) -> None:
        rows.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/v={version}")
        older = [v for v in versions(self.spark, self.root) if v < version]
        drop_versions(self.spark, self.root, older[:-keep])


# --- mergeable state -------------------------------------------------------

class MergeTable:
    """Keyed state as mergeable rows: a base and one folder per batch since.

    A batch costs what the batch holds, not what the state holds. ``merge``
    must be associative and idempotent, so a batch that is both in the base and
    still listed is harmless.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame],
                 schema: T.StructType):
        self.spark, self.merge, self.schema = spark, merge, schema
        self.base, self.recent = f"{root}/base", f"{root}/recent"

    def put(self, batch_id: int, rows: DataFrame) -> None:
        rows.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.recent}/v={batch_id}")

    def _paths(self, before: int | None) -> list[str]:
        known = lambda root: [v for v in versions(self.spark, root) if before is None or v < before]
        return ([f"{self.base}/v={v}" for v in known(self.base)[-1:]]
                + [f"{self.recent}/v={v}" for v in known(self.recent)])

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame:
        """State from all batches, or from those before a batch that may be a retry.

        ``where`` picks keys, so it may come before the merge and reach the scan.
        """
        paths = self._paths(before)
        if not paths:
            return nothing(self.spark, self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return self.merge(rows if where is None else rows.where(where))

    def replace(self, batch_id: int, rows: DataFrame) -> None:
        """Make ``rows`` the whole state as of a finished batch; a restart may repeat it."""
        rows.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.base}/v={batch_id}")
        drop_versions(self.spark, self.recent, [v for v in versions(self.spark, self.recent) if v <= batch_id])
        drop_versions(self.spark, self.base, [v for v in versions(self.spark, self.base) if v < batch_id])

    def compact(self, before: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Fold the batches below ``before``, all finished, into a new base, of which ``keep`` stays."""
        listed = [v for v in versions(self.spark, self.recent) if v < before]
        if not listed:
            return
        older = [v for v in versions(self.spark, self.base) if v < listed[-1]]
        keep(self.read(before)).write.mode("overwrite").parquet(f"{self.base}/v={listed[-1]}")
        drop_versions(self.spark, self.recent, listed)
        drop_versions(self.spark, self.base, older)


class DeltaTable:
    """Keyed rows as changes: a batch writes what it adds or replaces, and a tombstone for what it takes away.

    So a batch writes in proportion to itself, whatever the table holds. Compaction drops the tombstones.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str]):
        self.keys, self.schema = keys, schema
        self.table = MergeTable(spark, root, self._latest, T.StructType(
            [*schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("at", T.LongType())]))

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "at").alias("_row")).select(
            *[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])

    def read(self, before: int | None = None) -> DataFrame:
        return self.table.read(before).where(~F.col("gone")).drop("gone", "at")

    def put(self, batch_id: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """``rows`` as they are now; ``gone`` has the keys of what is no more. A key is in one of them."""
        changes = rows.select(*self.schema.fieldNames(), F.lit(False).alias("gone"))
        if gone is not None:
            changes = changes.unionByName(gone.select(*self.keys, F.lit(True).alias("gone")), allowMissingColumns=True)
        self.table.put(batch_id, changes.withColumn("at", F.lit(batch_id).cast("long")))

    def compact(self, before: int) -> None:
        self.table.compact(before, lambda rows: rows.where(~F.col("gone")))


# --- state that a reorganisation can take back --------------------------------

def _by_bucket(fold: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """``fold`` within each block bucket: the bucket travels inside the chain id, by which every fold groups."""
    tagged = rows.withColumn("chain_id", F.struct("chain_id", "block_bucket")).drop("block_bucket")
    return fold(tagged).withColumns({"block_bucket": F.col("chain_id.block_bucket"), "chain_id": F.col("chain_id.chain_id")})


class BucketState:
    """Keyed state as mergeable rows of one block bucket each.

    A cut (batch, chain, bucket) takes back all that earlier batches wrote for the chain from that bucket on; it
    is a filter on partition columns, so what lies below is neither read nor written for it. ``fold`` makes rows
    of events, ``merge`` combines rows; both use ``chain_id`` only to group by.
    """

    def __init__(self, spark: SparkSession, root: str, fold: Callable[[DataFrame], DataFrame],
                 merge: Callable[[DataFrame], DataFrame], schema: T.StructType):
        self.spark, self.root, self.fold, self.merge, self.schema = spark, root, fold, merge, schema
        self.stored = T.StructType([*schema.fields, T.StructField("part", T.StringType()), T.StructField("v", T.LongType()),
                                    T.StructField("block_bucket", T.LongType())])
        self.base, self.recent = f"{root}/part=base", f"{root}/part=recent"

    def put(self, batch_id: int, events: DataFrame, bucket_blocks: int) -> None:
        """A batch's events, folded by bucket."""
        bucket = F.floor(F.col("block_number") / bucket_blocks)
        self._write(f"{self.recent}/v={batch_id}", _by_bucket(self.fold, events.withColumn("block_bucket", bucket)))

    def _write(self, path: str, rows: DataFrame) -> None:
        rows.select(*self.schema.fieldNames(), "block_bucket").write.mode("overwrite").partitionBy("block_bucket").parquet(path)

    def rows(self, cuts: list[tuple[int, int, int]], before: int | None = None) -> DataFrame:
        """Rows by bucket that no cut took back."""
        known = lambda root: [v for v in versions(self.spark, root) if before is None or v < before]
        paths = [f"{self.base}/v={v}" for v in known(self.base)[-1:]] + [f"{self.recent}/v={v}" for v in known(self.recent)]
        if not paths:
            return nothing(self.spark, self.stored).drop("part", "v")
        rows = self.spark.read.option("basePath", self.root).schema(self.stored).parquet(*paths)
        for batch, chain, bucket in cuts:
            rows = rows.where((F.col("v") >= batch) | (F.col("block_bucket") < bucket) | (F.col("chain_id") != chain))
        return rows.drop("part", "v")

    def read(self, cuts: list[tuple[int, int, int]], before: int | None = None,
             only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The state; ``only`` may pick keys before the merge."""
        rows = self.rows(cuts, before)
        return self.merge((rows if only is None else only(rows)).drop("block_bucket"))

    def compact(self, cuts: list[tuple[int, int, int]], before: int) -> None:
        """Fold the batches below ``before``, all finished, into a new base, by bucket still.

        A cut counts as a batch, so that after this no cut below ``before`` is needed any more.
        """
        listed = [v for v in versions(self.spark, self.recent) if v < before]
        older = [v for v in versions(self.spark, self.base) if v < before]
        number = max([*listed, *[batch for batch, _, _ in cuts if batch < before]], default=-1)
        if number <= max(older, default=-1) or not (listed or older):
            return
        self._write(f"{self.base}/v={number}", _by_bucket(self.merge, self.rows(cuts, before)))
        drop_versions(self.spark, self.recent, listed)
        drop_versions(self.spark, self.base, older)
