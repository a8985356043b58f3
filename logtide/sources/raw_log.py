"""Raw logs laid out for scans by height, topic and address.

Folders are chain and block bucket; ``topic0`` is a column of its own; files are range-split and sorted by
address and carry Bloom filters on it. So a scan lists the folders of its range, reads row groups
whose topics and addresses fit, and a contract's past costs its own buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logtide.schemas import RAW_LOG
from logtide.session import sized
from logtide.sources.tables import BLOCKS_PER_BUCKET

#: So many contracts are named in the scan itself, where Bloom filters apply; more are a semi join.
MOST_NAMED = 200


class RawLog:
    """A growing table of undecoded logs under one folder."""

    def __init__(self, spark: SparkSession, path: str, bucket_blocks: int = BLOCKS_PER_BUCKET):
        self.spark, self.path, self.bucket_blocks = spark, path, bucket_blocks
        self.schema = T.StructType([*RAW_LOG.fields, T.StructField("topic0", T.BinaryType()), T.StructField("block_bucket", T.LongType())])

    def append(self, logs: DataFrame) -> None:
        """Logs without a block number go to bucket -1, where a scan of a range does not look."""
        rows = logs.select(*RAW_LOG.fieldNames(), F.get("topics", F.lit(0)).alias("topic0"),
                           F.coalesce(F.floor(F.col("block_number") / self.bucket_blocks), F.lit(-1)).alias("block_bucket"))
        order = ["chain_id", "block_bucket", "address", "block_number"]
        (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append")
         .option("parquet.bloom.filter.enabled#address", "true").option("parquet.bloom.filter.max.bytes", str(64 << 10))
         .partitionBy("chain_id", "block_bucket").parquet(self.path))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def between(self, start: int, end: int) -> DataFrame:
        """Logs of a block range, both ends included: folders first, then rows."""
        size = self.bucket_blocks
        return self.read().where(F.col("block_bucket").between(start // size, end // size) & F.col("block_number").between(start, end))

    def scan(self, topic0s: Iterable[str], start: int, end: int, contracts: DataFrame | None = None) -> DataFrame:
        """Logs of a block range with one of the topics, from the given contracts (chain_id, address)."""
        rows = self.between(start, end).where(F.col("topic0").isin([bytes.fromhex(t) for t in topic0s]))
        return (rows if contracts is None else self._of(rows, contracts)).select(RAW_LOG.fieldNames())

    def since(self, contracts: DataFrame) -> DataFrame:
        """All that contracts (chain_id, address, from_block) emitted from their block on, by the buckets from the first one on."""
        asked = sized(contracts.select("chain_id", "address", F.col("from_block").alias("_from")), "contracts")
        first = asked.groupBy("chain_id").agg(F.min("_from").alias("first")).collect()  # a row for each chain
        wanted = F.lit(False)
        for r in first:
            wanted |= (F.col("chain_id") == r["chain_id"]) & (F.col("block_bucket") >= r["first"] // self.bucket_blocks)
        rows = self._of(self.read().where(wanted), asked)
        on = (F.col("l.chain_id") == F.col("c.chain_id")) & (F.col("l.address") == F.col("c.address")) & (
            F.col("l.block_number") >= F.col("c._from"))
        return rows.alias("l").join(asked.alias("c"), on, "left_semi").select(RAW_LOG.fieldNames())

    def _of(self, rows: DataFrame, contracts: DataFrame) -> DataFrame:
        asked = sized(contracts.select("chain_id", "address").distinct(), "addresses")
        few = asked.select("address").distinct().limit(MOST_NAMED + 1).collect()
        if len(few) <= MOST_NAMED:
            rows = rows.where(F.col("address").isin([r["address"] for r in few]))
        return rows.join(asked, ["chain_id", "address"], "left_semi")
