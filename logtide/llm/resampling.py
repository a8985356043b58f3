"""Importance resampling towards a target distribution (operator 13).

Texts are cut by the tokenizers library: an untrained ``Split`` pre-tokenizer over the text with
A-Z in lower case gives words with their offsets. Windows over the offset pairs are the features (runs
of 1 to ``runs`` words joined by one space), each counted in the bucket of its CRC-32. Histograms over all
documents (source) and all texts of a target set give every bucket a gain, the logarithm of how much
more usual it is in the target. A document's weight is the sum of its features' gains; with Gumbel noise
from its id added, the highest scores are a sample without replacement in proportion to
the likelihood ratios.

Texts are cut once: each document's buckets are written to the shared folder (two bytes a
feature) and read for the histogram and for the sums. What reaches the driver is
one histogram of ``BUCKETS`` numbers. Ranks come in two levels: drawn rows go to ranges of score, are
numbered within them, and the ranges' sizes are summed, so no task and no window holds all of them.

A null text has no words; without features the weight is 0. A null id reads as empty text in the noise and
loses ties. Repeated rows are documents of their own. An empty table gives an empty result; an empty
target set gives gains all the same. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from logtide.llm import batches
from logtide.session import sized, work_dir

BUCKETS, RUNS, MIN_WORDS, PER_CENT, SEED = 10_000, 1, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters cut at a time: the library's result takes a hundred times the text, so a long text goes in parts.
PART = 200_000
#: Rows of a range that is ranked by itself, about.
RANGE_ROWS = 200_000
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_BREAK = frozenset(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


class Words:
    """Words of texts with their offsets, by the pre-tokenizer."""

    def __init__(self):
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def offsets(self, low: str):
        """Offset pairs of a lower-cased text's words, a list for each part; parts end before a character of no word."""
        start = 0
        while start < len(low):
            stop = min(start + PART, len(low))
            while stop < len(low) and low[stop] not in _BREAK:
                stop += 1
            yield [(start + a, start + b) for _, (a, b) in self.split.pre_tokenize_str(low[start:stop])]
            start = stop

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(word, start, end) in order; offsets are characters of ``text``."""
        low = lower_ascii(text)
        return [(low[a:b], a, b) for part in self.offsets(low) for a, b in part]


class _Buckets(dict):
    """Bucket of each feature met."""

    def __missing__(self, feature: str) -> int:
        bucket = self[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


class Features:
    """Buckets of texts' features: windows over 1 to ``runs`` consecutive offset pairs."""

    def __init__(self, runs: int = RUNS):
        self.words, self.runs = Words(), runs

    def __call__(self, text: str, known: _Buckets) -> tuple[int, np.ndarray]:
        """(number of words, buckets)."""
        low, n, out = lower_ascii(text), 0, []
        last: list[str] = []  # the words before a part that its windows may begin with
        for pairs in self.words.offsets(low):
            words = [low[a:b] for a, b in pairs]
            n += len(words)
            joined = last + words
            for size in range(1, self.runs + 1):
                first = max(0, len(last) - size + 1)  # windows that end in this part
                runs = words if size == 1 else [" ".join(joined[i:i + size]) for i in range(first, len(joined) - size + 1)]
                out.append(np.fromiter(map(known.__getitem__, runs), np.uint16, len(runs)))
            last = joined[-(self.runs - 1):] if self.runs > 1 else []
        return n, np.concatenate(out) if out else np.zeros(0, np.uint16)


def _bucketing(runs: int):
    features = Features(runs)

    def work(batch):
        known = _Buckets()
        found = [features(t, known) for t in batches.strings(batch)]
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        return kept | {"n_words": [n for n, _ in found], "n_features": [len(b) for _, b in found],
                       "buckets": [b.tobytes() for _, b in found]}

    return work


def bucketed(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The columns of ``docs`` but for the text, with n_words, n_features and buckets (16 bits each)."""
    schema = docs.drop("text").schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")
    return batches.map_texts(docs, _bucketing, schema, runs=runs)


def _counting(parts):
    """(bucket, n) of a task's rows."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in parts:
        for value in batch.column("buckets"):
            total += np.bincount(np.frombuffer(value.as_buffer() or b"", np.uint16), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def histogram(rows: DataFrame) -> np.ndarray:
    """Features of all rows by bucket: ``BUCKETS`` numbers at most come from a task, and to the driver."""
    counts = batches.map_arrow(rows.select("buckets"), _counting, "bucket bigint, n bigint")
    total = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log-ratio of each bucket, with one added to every count."""
    all_s, all_t = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _summing(gain):
    def run(parts):
        for batch in parts:
            weights = [int(gain[np.frombuffer(v.as_buffer() or b"", np.uint16)].sum()) for v in batch.column("buckets")]
            names = [n for n in batch.schema.names if n != "buckets"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(weights, pa.int64())], names=[*names, "weight"])

    return run


def noise(seed: int = SEED) -> Column:
    """Gumbel noise of a document in whole thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row; ``target`` has a column text."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "features")
    bucketed(batches.id_text(docs), runs).write.parquet(folder)
    rows = spark.read.parquet(folder)
    gain = gains(histogram(rows), histogram(bucketed(target.select("text"), runs)))
    schema = rows.drop("buckets").schema.add("weight", "long")
    return batches.map_arrow(rows, _summing(gain), schema).withColumn("score", F.col("weight") + noise(seed))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank in a total order, from 1.

    A range sort into about ``RANGE_ROWS`` rows each, row numbers within a range, and the sizes of the ranges before it.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = sized(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = sized(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before")), "range-starts")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return laid.withColumn("_within", within).join(starts, "_range").withColumn(
        name, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_range", "_within", "_before")


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, min_words: int = MIN_WORDS, per_cent: int = PER_CENT,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row."""
    rows = sized(scored(docs, target, runs, seed), "scores")
    fit = F.col("n_words") >= min_words
    drawn = per_cent * rows.filter(fit).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = ranked(rows.filter(fit).select(*columns), order)
    rest = rows.filter(~fit).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


#: DuckDB SQL for the query's rows; CRC-32 by its byte table, built here from its polynomial.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
             lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS by_byte),
texts AS (SELECT doc_id, NULL AS item, row_number() OVER () AS k, text, true AS is_doc FROM documents
          UNION ALL SELECT NULL, item_id, -row_number() OVER (), text, false FROM benchmark),
words AS (SELECT k, is_doc, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
buckets AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(word)) + 1),
            lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, by_byte[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
            FROM (SELECT DISTINCT word FROM words), crc),
counts AS (SELECT bucket, count(*) FILTER (is_doc) AS s, count(*) FILTER (NOT is_doc) AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS g
         FROM counts, sums),
per_doc AS (SELECT k, count(*) AS n_features, sum(g)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gain USING (bucket)
            WHERE is_doc GROUP BY k),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM texts LEFT JOIN per_doc USING (k) WHERE is_doc),
fit AS (SELECT *, n_features >= {MIN_WORDS} AS fits FROM scores),
placed AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS place FROM fit)
SELECT doc_id, n_features, weight, score,
       CASE WHEN fits AND place <= {PER_CENT} * (SELECT count(*) FROM fit WHERE fits) // 100 THEN place END AS rank FROM placed
"""
