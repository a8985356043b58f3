"""Stored state against the log: drift, sampled proofs, fingerprints, as-of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions import canonical as C, hexes
from logtide.operators import views
from logtide.operators.pages import PROOF_KINDS
from logtide.session import per_chain, sized


BUCKET_DIGITS = 3


# --- drift -----------------------------------------------------------------

def drift(stored: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose stored row is missing, surplus or different from a rebuild."""
    values = [c for c in rebuilt.columns if c not in keys]
    left = stored.select(*keys, F.struct(*values).alias("stored"))
    right = rebuilt.select(*keys, F.struct(*values).alias("rebuilt"))
    verdict = (
        F.when(F.col("stored").isNull(), F.lit("missing"))
        .when(F.col("rebuilt").isNull(), F.lit("surplus"))
        .when(~F.col("stored").eqNullSafe(F.col("rebuilt")), F.lit("different"))
    )
    return left.join(right, keys, "full_outer").withColumn("drift", verdict).where(
        F.col("drift").isNotNull())


def row_diff(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows on one side only, counted with multiplicity.

    One aggregate over both sides: each is read, and folded, once.
    """
    columns = stored.columns
    both = stored.withColumn("_n", F.lit(1)).unionByName(rebuilt.select(columns).withColumn("_n", F.lit(-1)))
    surplus = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, F.lit("stored")).otherwise(F.lit("rebuilt"))
    copies = F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_copy")
    return surplus.select(*columns, side.alias("side"), copies).drop("_copy")


# --- sampled proof check ---------------------------------------------------

def sampled(contract: Column, one_in: int) -> Column:
    """A fixed choice of one cluster in ``one_in``, from a hash of its address."""
    bucket = F.conv(F.substring(F.md5(hexes.hex0x(contract)), 1, 8), 16, 10).cast("long")
    return bucket % one_in == 0


def proof_check(answers: DataFrame, events: DataFrame, view: views.StateView, as_of: int,
                blocks: DataFrame | None = None, one_in: int = 100) -> DataFrame:
    """Sampled answers that their own proof events do not reproduce."""
    chosen = lambda rows: rows.where(sampled(F.col("contract"), one_in))
    proof = chosen(events).where(F.col("kind").isin(*PROOF_KINDS[view.name]))
    return drift(chosen(answers), view.replay(proof, as_of, blocks), list(view.keys))


# --- fingerprints ----------------------------------------------------------

def as_of_json(block_number: Column, block_hash: Column, block_timestamp: Column,
               finalized_block: Column, safety: Column) -> Column:
    return C.obj({
        "block_number": C.integer(block_number), "block_hash": C.text(hexes.hex0x(block_hash)),
        "block_timestamp": C.integer(block_timestamp), "finalized_block": C.integer(finalized_block),
        "safety": C.text(safety)})


def leader_json() -> Column:
    return C.obj({"memberId": C.text(hexes.hex0x(F.col("member_id"))), "epoch": C.integer(F.col("epoch")),
                  "asOfBlock": C.integer(F.col("as_of_block"))})


def member_json() -> Column:
    return C.obj({
        "memberId": C.text(hexes.hex0x(F.col("member_id"))),
        "instanceId": C.text(hexes.hex0x(F.col("instance_id"))),
        "passthrough": C.text(hexes.hex0x(F.col("passthrough"))),
        "dnsLabel": C.text(F.col("dns_label")), "publicEndpoint": C.text(F.col("public_endpoint")),
        "registeredAt": C.integer(F.col("registered_at")), "retiredAt": C.integer(F.col("retired_at"))})


def lifecycle_json() -> Column:
    return C.obj({"destroyedAt": C.integer(F.col("destroyed_at"))})


def fingerprints(rows: DataFrame, data: Column, resolved: DataFrame) -> DataFrame:
    """Answer rows with the digest of their JSON and the as-of record of their chain.

    ``resolved`` is the output of ``asof.resolve``, one row per chain; chains it
    could not place have no answer.
    """
    record = resolved.where(F.col("status") == "ok").select("chain_id", as_of_json(
        F.col("block_number"), F.col("block_hash"), F.col("block_timestamp"),
        F.col("finalized_block"), F.col("safety")).alias("_as_of"))
    return rows.withColumn("_data", data).join(per_chain(record), "chain_id").withColumn(
        "fingerprint", C.fingerprint(F.col("_data"), F.col("_as_of"))).drop("_data", "_as_of")


def combined_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One order-free digest per key over row fingerprints, in two levels.

    Row digests of a key that begin alike form a bucket (``BUCKET_DIGITS`` hex
    digits); a bucket's digest is that of its sorted row digests, the key's that of
    its ordered bucket digests. A key of any size spreads over its buckets, and
    nobody can swap rows unnoticed, as with a sum or xor of digests.
    """
    bucket = F.substring("fingerprint", 3, BUCKET_DIGITS)
    level = lambda values: F.sha2(F.array_join(F.array_sort(values), ""), 256)
    buckets = rows.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_rows"), level(F.collect_list("fingerprint")).alias("_digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda b: F.concat(b["_bucket"], b["_digest"]))
    return buckets.groupBy(*keys).agg(F.sum("_rows").alias("rows"), F.concat(
        F.lit("0x"), F.sha2(F.array_join(ordered, ""), 256)).alias("fingerprint"))


# --- as-of snapshots -------------------------------------------------------

SNAPSHOT_KEY = ["chain_id", "contract", "endpoint", "as_of_block"]


def missing_snapshots(requests: DataFrame, stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """Requested keys without a stored snapshot, or whose block has since been replaced."""
    truth = canonical.select("chain_id", F.col("number").alias("as_of_block"),
                             F.col("hash").alias("as_of_hash"))
    wanted = requests.where(F.col("as_of_block").isNotNull()).select(*SNAPSHOT_KEY).distinct()
    return wanted.join(truth, ["chain_id", "as_of_block"]).join(
        stored.select(*SNAPSHOT_KEY, "as_of_hash"), SNAPSHOT_KEY + ["as_of_hash"], "left_anti")


def snapshot_rows(answers: DataFrame, endpoint: str, data: Column, as_of_block: int,
                  item: Column | None = None) -> DataFrame:
    """Answers as snapshot rows; a member set is one row per member (``item``)."""
    return answers.select(
        "chain_id", "contract", F.lit(endpoint).alias("endpoint"),
        F.lit(as_of_block).cast("long").alias("as_of_block"),
        (item if item is not None else F.lit("")).alias("item"), data.alias("payload"))


def materialise(missing: DataFrame, events: DataFrame, blocks: DataFrame, as_of_block: int) -> DataFrame:
    """Snapshot rows for the missing keys of one block, to append.

    The wanted keys are written first. Events of other clusters fall away
    before any fold, and only endpoints that someone asked for are folded.
    """
    want = sized(missing.where(F.col("as_of_block") == as_of_block), "wanted-snapshots")
    clusters = want.select("chain_id", "contract").distinct()
    mine = events.join(clusters, ["chain_id", "contract"], "left_semi")
    parts = {
        "leader": lambda: snapshot_rows(
            views.leader_for(clusters, views.LEADER.replay(mine, as_of_block), as_of_block), "leader", leader_json(), as_of_block),
        "lifecycle": lambda: snapshot_rows(
            views.lifecycle_for(clusters, views.LIFECYCLE.replay(mine, as_of_block, blocks)), "lifecycle", lifecycle_json(), as_of_block),
        "members": lambda: snapshot_rows(
            views.MEMBERS.replay(mine, as_of_block, blocks), "members", member_json(), as_of_block, hexes.hex0x(F.col("member_id"))),
    }
    asked = sorted({r["endpoint"] for r in want.select("endpoint").distinct().collect()} & set(parts)) or ["leader"]
    return reduce(DataFrame.unionByName, [parts[name]() for name in asked]).join(want, SNAPSHOT_KEY)


def materialise_many(missing: DataFrame, events: DataFrame, blocks: DataFrame, bucket_blocks: int = 10_000) -> DataFrame:
    """Snapshot rows for the missing keys of any number of blocks, to append; see :func:`views.as_of_many`."""
    want = sized(missing, "wanted-snapshots")
    on = ["chain_id", "contract", "as_of_block"]
    points = want.select(*on).distinct().withColumn("request_id", F.lit(0))

    def answers(view: views.StateView) -> DataFrame:
        return views.as_of_many(view, events, points, blocks, bucket_blocks).drop("request_id")

    def rows(found: DataFrame, endpoint: str, data: Column, item: Column | None = None) -> DataFrame:
        return found.select(*on, F.lit(endpoint).alias("endpoint"), (F.lit("") if item is None else item).alias("item"), data.alias("payload"))

    leaders = points.join(answers(views.LEADER), on, "left").withColumns({
        "member_id": F.coalesce("member_id", F.lit(hexes.ZERO32)), "epoch": F.coalesce("epoch", F.lit(0))})
    parts = {
        "leader": lambda: rows(leaders, "leader", leader_json()),
        "lifecycle": lambda: rows(points.join(answers(views.LIFECYCLE), on, "left"), "lifecycle", lifecycle_json()),
        "members": lambda: rows(answers(views.MEMBERS), "members", member_json(), hexes.hex0x(F.col("member_id"))),
    }
    asked = sorted({r["endpoint"] for r in want.select("endpoint").distinct().collect()} & set(parts)) or ["leader"]
    return reduce(DataFrame.unionByName, [parts[name]() for name in asked]).join(want, SNAPSHOT_KEY)


def put_snapshots(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored snapshots with those of the refreshed keys replaced."""
    return stored.join(fresh.select(*SNAPSHOT_KEY).distinct(), SNAPSHOT_KEY, "left_anti").unionByName(fresh)
