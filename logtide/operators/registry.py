"""Watched contracts: registration, discovery, membership, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.operators.ingest import first_write
from logtide.operators.views import canonical

FACTORY = "factory"
CLUSTER_KIND = "cluster_diamond"
KEY = ["chain_id", "address"]


def seed_factories(configured: DataFrame) -> DataFrame:
    """Watched rows for configured factories (chain_id, address, from_block); of repeated ones the earliest."""
    rows = configured.select("chain_id", "address", F.lit(FACTORY).alias("kind"), F.lit(None).cast("binary").alias("parent"),
                             F.col("from_block").cast("long").alias("from_block"))
    return first_write(rows, KEY, ["from_block"])


def register(watched: DataFrame, added: DataFrame) -> DataFrame:
    """Watched table after registration; an address already present keeps its row."""
    fresh = first_write(added, KEY, ["from_block", "parent"]).join(watched.select(*KEY), KEY, "left_anti")
    return watched.unionByName(fresh)


def deployments(events: DataFrame) -> DataFrame:
    """Live ClusterDeployed events whose payload holds an address."""
    return canonical(events).where((F.col("kind") == "ClusterDeployed") & (F.octet_length("decoded.diamond") == 20))


def discover(events: DataFrame) -> DataFrame:
    """Clusters minted by every live ClusterDeployed event, first deployment per address."""
    deployed = deployments(events)
    first = F.min(F.struct("block_number", "log_index", "contract")).alias("first")
    return (
        deployed.groupBy("chain_id", F.col("decoded.diamond").alias("address")).agg(first)
        .select("chain_id", "address", F.lit(CLUSTER_KIND).alias("kind"),
                F.col("first.contract").alias("parent"), F.col("first.block_number").alias("from_block"))
    )


def rediscover(watched: DataFrame, events: DataFrame) -> DataFrame:
    """Watched table rebuilt from the log without losing registered rows."""
    return register(watched, discover(events))


def contains(probes: DataFrame, watched: DataFrame) -> DataFrame:
    """For each (chain_id, factory, address): did that factory mint that cluster?"""
    clusters = watched.where(F.col("kind") == CLUSTER_KIND).select(
        "chain_id", F.col("parent").alias("factory"), "address", F.lit(True).alias("_found"))
    return probes.join(clusters, ["chain_id", "factory", "address"], "left").withColumn(
        "contains", F.coalesce("_found", F.lit(False))).drop("_found")


def clusters_of(watched: DataFrame, factory: bytes | None = None) -> DataFrame:
    """Clusters by deploy block, of one factory or of all."""
    rows = watched.where((F.col("kind") == CLUSTER_KIND) & F.col("parent").isNotNull())
    if factory is not None:
        rows = rows.where(F.col("parent") == F.lit(factory))
    return rows.select("chain_id", F.col("parent").alias("factory"), "address", "from_block").orderBy(
        "factory", "from_block", "address")


def listing(watched: DataFrame) -> DataFrame:
    return watched.orderBy("from_block", "address")
