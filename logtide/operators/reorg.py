"""Chain reorganisation: detection, common ancestor, orphans, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.session import per_chain, sized


def detect(headers: DataFrame, stored: DataFrame) -> DataFrame:
    """Headers that contradict the stored chain.

    ``stored`` must be the chain as it was before these headers were merged.
    Each header probes two heights (its own and its parent's) in one join.
    """
    probes = headers.select(
        "chain_id", "number", F.explode(F.array(
            F.struct(F.lit("parent_mismatch").alias("signal"), (F.col("number") - 1).alias("height"),
                     F.col("parent_hash").alias("expected")),
            F.struct(F.lit("hash_changed").alias("signal"), F.col("number").alias("height"),
                     F.col("hash").alias("expected")),
        )).alias("probe")).select("chain_id", "number", "probe.*")
    local = stored.select("chain_id", F.col("number").alias("height"), F.col("hash").alias("local_hash"))
    differs = F.col("expected") != F.col("local_hash")
    flag = lambda signal: F.bool_or(differs & (F.col("signal") == signal))
    return (
        probes.join(local, ["chain_id", "height"])
        .groupBy("chain_id", "number")
        .agg(flag("parent_mismatch").alias("parent_mismatch"), flag("hash_changed").alias("hash_changed"))
        .where(F.col("parent_mismatch") | F.col("hash_changed"))
    )


def choose_forks(headers: DataFrame) -> DataFrame:
    """One header for each height, the one on the branch that reaches furthest; of equal ones the later arrival.

    Every header learns the best tip above it by pointer doubling over parent hashes: in round r it hands
    what it knows to its ancestor 2^r below, so a fork of n heights takes log2(n) rounds of joins on hashes. Only the
    heights from a chain's lowest fork on take part; without a fork nothing is joined. Arrival
    is the order of rows in the input. Each round is written, so a lost executor repeats one round.
    """
    columns = ["chain_id", "number", "hash", "parent_hash", "block_ts"]
    found = headers.select(*columns, F.monotonically_increasing_id().alias("turn")).groupBy("chain_id", "number", "hash").agg(
        F.max_by(F.struct("parent_hash", "block_ts"), "turn").alias("row"), F.max("turn").alias("turn"))
    found = sized(found.select("chain_id", "number", "hash", "row.parent_hash", "row.block_ts", "turn"), "headers")
    forks = found.groupBy("chain_id", "number").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    lowest = per_chain(forks.groupBy("chain_id").agg(F.min("number").alias("lowest")))
    branches = found.join(lowest, "chain_id").where(F.col("number") >= F.col("lowest"))
    span = branches.agg((F.max("number") - F.min("number")).alias("n")).first()["n"]
    if span is None:
        return found.select(*columns)
    known = branches.select("chain_id", "hash", F.col("parent_hash").alias("below"), F.struct("number", "turn").alias("tip"))
    for _ in range(max(1, int(span).bit_length())):
        handed = known.groupBy("chain_id", F.col("below").alias("hash")).agg(F.max("tip").alias("handed"))
        jump = known.select("chain_id", F.col("hash").alias("below"), F.col("below").alias("next"))
        known = sized(known.join(handed, ["chain_id", "hash"], "left").join(jump, ["chain_id", "below"], "left").select(
            "chain_id", "hash", F.col("next").alias("below"), F.greatest("tip", "handed").alias("tip")), "tips")
    best = F.max_by(F.struct("hash", "parent_hash", "block_ts"), F.struct("tip", "turn", "hash")).alias("best")
    settled = branches.join(known.select("chain_id", "hash", "tip"), ["chain_id", "hash"]).groupBy("chain_id", "number").agg(best)
    return found.join(lowest, "chain_id", "left").where(F.col("lowest").isNull() | (F.col("number") < F.col("lowest"))).select(
        *columns).unionByName(settled.select("chain_id", "number", "best.*"))


def common_ancestor(heads: DataFrame, local: DataFrame, canonical: DataFrame,
                    finality_depth: int) -> DataFrame:
    """Highest agreed height per head, looking at most ``finality_depth`` below it.

    ``heads`` is (chain_id, head). A height without a local block agrees; below
    genesis block 0 agrees. Status is OK, DEEPER_THAN_FINALITY, or
    NO_CANONICAL_BLOCK where the walk meets a height the canonical side lacks.
    """
    lowest = F.greatest(F.col("head") - finality_depth, F.lit(0))
    heights = heads.select("chain_id", "head", F.explode(F.sequence(lowest, "head")).alias("number"))
    mine = local.select("chain_id", "number", F.col("hash").alias("local_hash"))
    theirs = canonical.select("chain_id", "number", F.col("hash").alias("canonical_hash"))
    agrees = F.col("local_hash").isNull() | (F.col("local_hash") == F.col("canonical_hash"))
    stuck = F.col("local_hash").isNotNull() & F.col("canonical_hash").isNull()
    walk = (
        heights.join(mine, ["chain_id", "number"], "left").join(theirs, ["chain_id", "number"], "left")
        .groupBy("chain_id", "head")
        .agg(F.max(F.when(agrees, F.col("number"))).alias("agreed"),
             F.max(F.when(stuck, F.col("number"))).alias("stuck"))
    )
    agreed = F.coalesce("agreed", F.when(F.col("head") < finality_depth, F.lit(0)))
    status = (
        F.when(F.col("stuck") > F.coalesce(agreed, F.lit(-1)), F.lit("NO_CANONICAL_BLOCK"))
        .when(agreed.isNull(), F.lit("DEEPER_THAN_FINALITY"))
        .otherwise(F.lit("OK"))
    )
    return (
        walk.withColumn("status", status)
        .select("chain_id", "head", F.when(F.col("status") == "OK", agreed).alias("ancestor"), "status")
    )


def orphan_blocks(events: DataFrame, canonical: DataFrame) -> DataFrame:
    """(chain_id, block_number, block_hash) stored but not canonical at that height.

    Events reduce to distinct blocks before anything is shuffled, so the join
    sees blocks, not events. Heights the canonical side lacks are left alone.
    The list is written out: marking events with it then needs no shuffle of
    theirs while it is small.
    """
    stored = events.select("chain_id", "block_number", "block_hash").distinct()
    truth = canonical.select("chain_id", F.col("number").alias("block_number"),
                             F.col("hash").alias("canonical_hash"))
    orphans = stored.join(truth, ["chain_id", "block_number"]).where(
        F.col("block_hash") != F.col("canonical_hash"))
    return sized(orphans.select("chain_id", "block_number", "block_hash"), "orphan-blocks")


def mark_removed(events: DataFrame, orphans: DataFrame) -> DataFrame:
    """Set ``removed`` from the orphan list, which is short in any sane chain."""
    marks = orphans.withColumn("_orphan", F.lit(True))
    return (
        events.join(marks, ["chain_id", "block_number", "block_hash"], "left")
        .withColumn("removed", F.coalesce("_orphan", F.lit(False)))
        .select(events.columns)
    )


def survivors(events: DataFrame, orphans: DataFrame) -> DataFrame:
    return events.join(orphans, ["chain_id", "block_number", "block_hash"], "left_anti")


def roll_back(rows: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Rows with ``removed`` set above the ancestor; ``flipped`` marks this rollback's own.

    ``ancestors`` is (chain_id, ancestor), one row per reorganised chain.
    """
    above = F.coalesce(F.col("block_number") > F.col("ancestor"), F.lit(False))
    return (
        rows.join(per_chain(ancestors.select("chain_id", "ancestor")), "chain_id", "left")
        .withColumn("flipped", above & ~F.col("removed"))
        .withColumn("removed", F.col("removed") | above)
        .drop("ancestor")
    )


def rollback_counts(rolled_back: DataFrame) -> DataFrame:
    return rolled_back.groupBy("chain_id").agg(F.count_if("flipped").alias("removed_rows"))
