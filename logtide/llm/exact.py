"""Exact dedup over a persistent digest index (operator 11).

The index is a table with a row for each distinct text, bucketed and sorted by the text's
SHA-256. New data is reduced to its distinct digests (in the input tasks first, so copies
never meet in one), goes to the index's buckets once, and a sort-merge anti-join
leaves what the index lacks; that is appended, already in bucket order. The index itself
never moves. What came earlier stays; within one append the largest doc_id stays.

Two texts are equal when their digests are, after lower-casing A-Z alone; null counts as
empty. A null doc_id is smaller than any other. Of rows that are equal in doc_id and
text exactly one stays. An empty table leaves the index as it is. Only doc_id and
text are read, so further columns cannot clash.

An append that is repeated, say after a lost driver, finds its digests there and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import batches
from logtide.session import sized, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for each row), digest; written once, so texts are read once."""
    text = lower_ascii(batches.text_or_empty())
    return sized(docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                             F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "digests")


class DigestIndex:
    """The index under a folder that all executors share.

    A folder holds numbered generations; the last complete one counts. The
    number of buckets is fixed when a generation is made and stands in its name, so any later
    session can open it. Keep it at about the final bytes of the index over what a task may sort.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        found = self._generations()
        self.number, self.buckets = found[-1] if found else (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._register()

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of the complete generations, in order."""
        fs, root = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(tuple(map(int, n.split("-")[1:])) for n in names
                      if n.startswith("generation-") and fs.exists(self._fs(f"{self.folder}/{n}/_SUCCESS")[1]))

    def _path(self, number: int) -> str:
        return f"{self.folder}/generation-{number}-{self.buckets}"

    def _register(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._path(self.number)}'")

    def read(self) -> DataFrame:
        """digest, keep_id, keep_row (the row's number within its append)."""
        return self.spark.table(self.table)

    def unseen(self, new: DataFrame) -> DataFrame:
        """Distinct digests of ``new`` (doc_id, row, digest) that the index lacks, each with the row that stays."""
        rank = F.coalesce("doc_id", F.lit(-1 << 63))  # numbers, not structs: these aggregate by hash
        distinct = new.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("row", rank).alias("keep_row"))
        return distinct.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, number: int, mode: str) -> None:
        (rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest")
         .sortBy("digest").option("path", self._path(number)).saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)

    def append(self, new: DataFrame) -> None:
        """Add what is new under its digest.

        The join's tasks are the index's buckets, so each adds one sorted file to its own.
        """
        self._write(self.unseen(new), self.number, "append")

    def compact(self) -> None:
        """One file a bucket again, in a generation of its own; readers of the old one are not disturbed."""
        rows, table = self.read().repartition(self.buckets, "digest"), self.table
        self.table, number = f"digest_index_{uuid.uuid4().hex}", self.number + 1
        self._write(rows, number, "overwrite")
        self.number = number
        self.spark.sql(f"DROP TABLE {table}")

    def close(self) -> None:
        """Forget the name in this session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def index_documents(docs: DataFrame, parts: int = 2) -> tuple[DataFrame, DigestIndex]:
    """(digests of all rows, an index of them), made by ``parts`` appends from the largest ids down.

    So that of equal texts the largest doc_id is there first: ids go in ranges of equal width, those without an id last.
    """
    rows = digests(docs)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = DigestIndex(docs.sparkSession, work_dir(docs.sparkSession, "digest-index"))
    bounds = [] if low is None else sorted({low + (high - low) * i // parts for i in range(1, parts)}, reverse=True)
    before = F.lit(True)
    for bound in bounds:
        index.append(rows.where(before & (F.col("doc_id") >= bound)))
        before = F.col("doc_id") < bound
    index.append(rows.where(before | F.col("doc_id").isNull()))
    return rows, index


def keep_one(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Group sizes are counted in the input tasks first. The last join has a row of
    each group on one side and all rows on the other, so a text with a large share of
    the rows is a skewed join, which adaptive execution splits.
    """
    rows, index = index_documents(docs)
    counts = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = sized(counts.hint("merge").join(index.read().hint("merge"), "digest"), "digest-groups")
    index.close()
    # keep_row is the row's number in the one table of digests that all appends came from
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
