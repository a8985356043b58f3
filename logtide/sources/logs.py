"""Log and header sources, batch and streaming.

Node responses are JSON lines in the public Ethereum JSON-RPC shape; tables
are parquet. The streaming readers take the same files as the batch ones, so a
backlog and its tail are one source and the checkpoint is the cursor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logtide.functions import hexes, numbers
from logtide.schemas import BLOCK, RAW_LOG

RPC_LOG = T.StructType([
    T.StructField("address", T.StringType()), T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("data", T.StringType()), T.StructField("blockNumber", T.StringType()),
    T.StructField("blockHash", T.StringType()), T.StructField("transactionHash", T.StringType()),
    T.StructField("logIndex", T.StringType()), T.StructField("removed", T.BooleanType()),
])
RPC_HEADER = T.StructType([
    T.StructField("number", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("parentHash", T.StringType()), T.StructField("timestamp", T.StringType()),
])


def from_rpc_logs(rows: DataFrame, chain_id: int) -> DataFrame:
    """Raw logs of node responses; a retraction (``removed``) is none, see :func:`retracted_blocks`.

    Nodes number nothing: ``event_id`` is NULL, and the live log gives each new row the next arrival id.
    """
    return rows.where(~F.coalesce("removed", F.lit(False))).select(*rpc_log(chain_id))


def rpc_log(chain_id: int) -> list[Column]:
    """A node response's columns as a raw log's."""
    number, index = (numbers.parse_uint_as_int64(F.col(c)) for c in ("blockNumber", "logIndex"))
    return [
        F.lit(None).cast("long").alias("event_id"), F.lit(chain_id).alias("chain_id"),
        hexes.parse_fixed(F.col("address"), 20).alias("address"),
        F.transform("topics", lambda t: hexes.parse_fixed(t, 32)).alias("topics"),
        hexes.parse_bytes(F.col("data")).alias("data"), number.alias("block_number"),
        hexes.parse_fixed(F.col("blockHash"), 32).alias("block_hash"),
        hexes.parse_fixed(F.col("transactionHash"), 32).alias("tx_hash"), index.alias("log_index")]


def retracted_blocks(rows: DataFrame, chain_id: int) -> DataFrame:
    """(chain_id, block_number, block_hash) that a node took back, once for each log in it."""
    return rows.where("removed").select(*rpc_block(chain_id))


def rpc_block(chain_id: int) -> list[Column]:
    """A node response's columns as the block that it lies in."""
    return [
        F.lit(chain_id).alias("chain_id"), numbers.parse_uint_as_int64(F.col("blockNumber")).alias("block_number"),
        hexes.parse_fixed(F.col("blockHash"), 32).alias("block_hash")]


def from_rpc_headers(rows: DataFrame, chain_id: int) -> DataFrame:
    return rows.select(
        F.lit(chain_id).alias("chain_id"), numbers.parse_uint_as_int64(F.col("number")).alias("number"),
        hexes.parse_fixed(F.col("hash"), 32).alias("hash"),
        hexes.parse_fixed(F.col("parentHash"), 32).alias("parent_hash"),
        numbers.parse_uint_as_int64(F.col("timestamp")).alias("block_ts"))


def read_rpc_logs(spark: SparkSession, path: str, chain_id: int) -> DataFrame:
    return from_rpc_logs(spark.read.schema(RPC_LOG).json(path), chain_id)


def read_rpc_headers(spark: SparkSession, path: str, chain_id: int) -> DataFrame:
    return from_rpc_headers(spark.read.schema(RPC_HEADER).json(path), chain_id)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOG).parquet(path)


def _stream(spark: SparkSession, fmt: str, schema: T.StructType, path: str,
            files_per_batch: int | None, pattern: str | None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream_rpc_rows(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Node responses as they are: logs and retractions in one stream."""
    return _stream(spark, "json", RPC_LOG, path, files_per_batch, None)


def stream_rpc_logs(spark: SparkSession, path: str, chain_id: int,
                    files_per_batch: int | None = None) -> DataFrame:
    return from_rpc_logs(stream_rpc_rows(spark, path, files_per_batch), chain_id)


def stream_rpc_headers(spark: SparkSession, path: str, chain_id: int,
                       files_per_batch: int | None = None) -> DataFrame:
    return from_rpc_headers(_stream(spark, "json", RPC_HEADER, path, files_per_batch, None), chain_id)


def stream_table(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """A growing parquet table as a stream."""
    return _stream(spark, "parquet", schema, path, files_per_batch, pattern)


def stream_logs(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return stream_table(spark, path, RAW_LOG, files_per_batch)


def stream_headers(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return stream_table(spark, path, BLOCK, files_per_batch)


def stream_kafka_logs(spark: SparkSession, servers: str, topic: str, chain_id: int) -> DataFrame:
    """RPC-shaped log messages from Kafka; the session must carry Spark's Kafka connector."""
    messages = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    )
    body = F.from_json(F.col("value").cast("string"), RPC_LOG)
    return from_rpc_logs(messages.select(body.alias("m")).select("m.*"), chain_id)
