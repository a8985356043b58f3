"""Cold-start backfill: scan, decode and discover until the watched set is stable."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from logtide.operators import decode, ingest, registry

ScanPlan = Callable[[DataFrame], DataFrame]


def backfill(scan: ScanPlan, watched: DataFrame, cursors: DataFrame, heads: DataFrame, folder: str,
             specs: Iterable[decode.EventSpec] = decode.DEFAULT_SPECS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, watched, cursors) after every watched contract reached its head.

    ``scan`` reads the logs of a plan (see ``ingest.scan_plan``). Factories come
    first; clusters they minted are scanned in the next round, and so on until a
    round plans nothing. Rounds follow the depth of discovery, not the data.
    Each round's events, watched set and cursors are written under ``folder``,
    so a later round reads tables and not a growing lineage.
    """
    spark = watched.sparkSession
    paths: list[str] = []
    while True:
        plan = ingest.plan_backfill(watched, cursors, heads)
        if plan.isEmpty():
            break
        root = f"{folder}/round={len(paths)}"
        events, rejects = decode.decode_logs(scan(plan), specs)
        ingest.append_events(events).write.parquet(f"{root}/events")
        rejects.write.parquet(f"{root}/rejects")
        found = spark.read.parquet(f"{root}/events")
        paths.append(f"{root}/events")
        done = plan.select("chain_id", "contract", (F.col("to_block") + 1).alias("next_block"))
        ingest.advance_cursors(cursors, done).write.parquet(f"{root}/cursors")
        registry.rediscover(watched, found).write.parquet(f"{root}/watched")
        cursors = spark.read.parquet(f"{root}/cursors")
        watched = spark.read.parquet(f"{root}/watched")
    events = spark.read.parquet(*paths) if paths else None
    return events, watched, cursors
