"""Hard-negative mining by exact products in a residue number system (operator 12).

Components become whole numbers, floor(256 * x). Scores are whole inner products, taken by
float32 matrix products modulo several small primes: residues lie around zero and are so small that a product's
sums stay below 2^24, where float32 counts exactly. Chinese remaindering (in mixed radix with
signed digits) gives the exact signed score back.

A second half needs what the first finds, so the products are taken in two rounds. Round one, within a label
only, finds each anchor's first positives; round two finds, for each positive, the best rows of other labels in
the window its score opens: 50 * positive <= 100 * negative <= 95 * positive.

Anchors are a stated query set and meet all rows in blocks. Rows lie in blocks of a bounded size by a hash of their
number; a task holds one block and the anchors stream past it in tiles, so an anchor is sent
once to each block and never a row to an anchor. A block answers with each anchor's best few, which meet in a
window for each anchor. Labels and equal vectors of any share spread over all blocks.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; nor do vectors
whose squared length reaches 2^60, whose scores could leave a long. Vectors of different lengths count
as if zeros followed; an empty one scores 0. "Other rows" have another vec_id; an anchor that is repeated gives its
rows again. Ties go to the smaller vec_id. An empty table gives an empty result. Only vec_id, label and
embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm import batches
from logtide.session import sized

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows of a block take about this much of a task's memory; so many blocks there are at least.
BLOCK_BYTES, MIN_BLOCKS = 128 << 20, 16
#: Rows and anchors whose scores are in memory at once, and columns that one product sums.
ROW_TILE, ANCHOR_TILE, PANEL = 4_096, 256, 4_096
LONGEST_SQUARED = 2.0**60
NONE, NO_ID = -(1 << 62), (1 << 63) - 1


def primes_for(columns: int, largest: int) -> list[int]:
    """The largest primes that float32 sums of ``columns`` products allow, until they tell scores up to ``largest`` apart."""
    half = math.isqrt((2**24 - 1) // max(1, min(columns, PANEL)))
    top = min(2 * half + 1, 8_191)
    sieve = np.ones(top + 1, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(top) + 1):
        sieve[i * i::i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if p > 2 and (product <= 2 * largest or len(out) < 2):
            out.append(p)
            product *= p
    return out


class Residues:
    """Exact inner products of whole vectors by residues."""

    def __init__(self, columns: int, largest: int):
        self.columns, self.primes = columns, primes_for(columns, largest)

    def take(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Residues around zero of each component by each prime, as float32."""
        out = []
        for p in self.primes:
            r = vectors % p
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Scores of all rows of ``left`` with all of ``right`` as int64."""
        value, radix = None, 1
        for p, a, b in zip(self.primes, left, right):
            r = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, self.columns, PANEL):
                r += (a[:, at:at + PANEL] @ b[:, at:at + PANEL].T).astype(np.int32)
            if value is not None:  # the digit of this prime in mixed radix
                r = (r - value) % p * pow(radix, -1, p)
            r %= p
            r -= p * (r > p // 2)
            # wraps beyond 64 bits only where no score can be
            value = r if value is None else value + r * np.array(radix & (2**64 - 1), np.uint64).astype(np.int64)
            radix *= p
        return value


# --- whole vectors -----------------------------------------------------------

_PACKED = "row bigint, vec_id bigint, label bigint, width int, squared double, vector binary"


def _packing(parts):
    for batch in parts:
        lists = batch.column("embedding")
        if not len(lists):
            continue
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        values = np.floor(256 * pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        keep, widths, squares, packed = [], [], [], []
        for i, (start, stop) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            v = values[start:stop]
            with np.errstate(over="ignore", invalid="ignore"):
                squared = float(v @ v)
            if squared < LONGEST_SQUARED:  # false for what is not finite, too
                small = not len(v) or np.abs(v).max() < 32_768
                keep.append(i)
                widths.append(2 if small else 8)
                squares.append(squared)
                packed.append(v.astype(np.int16 if small else np.int64).tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n).take(at) for n in ("row", "vec_id", "label")], pa.array(widths, pa.int32()),
             pa.array(squares, pa.float64()), pa.array(packed, pa.binary())],
            names=["row", "vec_id", "label", "width", "squared", "vector"])


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows that take part, with whole components in two (or, where one is large, eight) bytes each; written once."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return sized(batches.map_arrow(known.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"), "embedding"), _packing, _PACKED), "vectors")


def unpacked(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Vectors of a batch as int64, zeros to the right."""
    out = np.zeros((batch.num_rows, columns), np.int64)
    for i, (width, vector) in enumerate(zip(batch.column("width").to_pylist(), batch.column("vector"))):
        v = np.frombuffer(vector.as_buffer(), np.int16 if width == 2 else np.int64)
        out[i, :len(v)] = v
    return out


# --- blocks ------------------------------------------------------------------

class Best:
    """The best ``k`` rows of each anchor so far, ties by the smaller id."""

    def __init__(self, anchors: int, k: int):
        self.k, self.scores, self.ids = k, np.full((anchors, k), NONE, np.int64), np.full((anchors, k), NO_ID, np.int64)

    def offer(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (changed here) of some anchors with rows in the order of their ids; NONE is no row."""
        at = np.arange(len(scores))
        found = [(self.scores[anchors], self.ids[anchors])]
        for _ in range(min(self.k, scores.shape[1])):
            first = scores.argmax(axis=1)  # of equal scores the first, which has the smallest id
            best = scores[at, first]
            found.append((best[:, None], np.where(best > NONE, ids[first], NO_ID)[:, None]))
            scores[at, first] = NONE
        s, i = (np.concatenate(x, axis=1) for x in zip(*found))
        order = np.lexsort((i, -s), axis=1)[:, :self.k]
        self.scores[anchors], self.ids[anchors] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, id, score) of all that were found."""
        anchor, place = np.nonzero(self.scores > NONE)
        return anchor, self.ids[anchor, place], self.scores[anchor, place]


class Block:
    """Rows of one block, by label and id."""

    def __init__(self, parts: list[pa.RecordBatch], columns: int):
        ids, labels = (np.concatenate([p.column(n).to_numpy() for p in parts]) for n in ("vec_id", "label"))
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        vectors = [unpacked(p, columns) for p in parts]
        if all(np.abs(v).max(initial=0) < 32_768 for v in vectors):
            vectors = [v.astype(np.int16) for v in vectors]
        self.vectors = np.concatenate(vectors)[order]

    def tiles(self):
        """(label, slice): pieces of rows of one label."""
        cuts = [0, *(np.flatnonzero(np.diff(self.labels)) + 1).tolist(), len(self.labels)]
        for start, stop in zip(cuts, cuts[1:]):
            for at in range(start, stop, ROW_TILE):
                yield self.labels[at], slice(at, min(at + ROW_TILE, stop))


def find_positives(block: Block, anchors: pa.RecordBatch, vectors: np.ndarray, system: Residues) -> pa.RecordBatch:
    """Best rows of each anchor's own label in a block."""
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    best = Best(len(ids), POSITIVES)
    residues = system.take(vectors)
    for label, tile in block.tiles():
        mine = np.flatnonzero(labels == label)
        if not len(mine):
            continue
        right, near = system.take(block.vectors[tile].astype(np.int64)), block.ids[tile]
        for at in range(0, len(mine), ANCHOR_TILE):
            some = mine[at:at + ANCHOR_TILE]
            scores = system.scores([r[some] for r in residues], right)
            first, last = np.searchsorted(near, ids[some]), np.searchsorted(near, ids[some], "right")
            for i in np.flatnonzero(first < last).tolist():  # the anchor itself
                scores[i, first[i]:last[i]] = NONE
            best.offer(some, scores, near)
    anchor, found, score = best.rows()
    return pa.RecordBatch.from_arrays(
        [anchors.column(n).take(pa.array(anchor)) for n in ("row", "vec_id")] + [pa.array(found), pa.array(score)],
        names=["anchor_row", "anchor_id", "positive_id", "positive_score"])


def find_negatives(block: Block, anchors: pa.RecordBatch, vectors: np.ndarray, system: Residues) -> pa.RecordBatch:
    """Best rows of other labels in a block, for the window of each of an anchor's positives."""
    labels, n = anchors.column("label").to_numpy(), anchors.num_rows
    positive = np.full((n, POSITIVES), NONE, np.int64)
    for i, scores in enumerate(anchors.column("positive_scores").to_pylist()):
        positive[i, :len(scores)] = scores
    known = positive > NONE
    # 50 p <= 100 s <= 95 p in whole scores; an empty window where there is no positive
    low = np.where(known, -(-LEAST * np.where(known, positive, 0) // 100), 0)
    high = np.where(known, MOST * np.where(known, positive, 0) // 100, -1)
    best = [Best(n, NEGATIVES) for _ in range(POSITIVES)]
    residues = system.take(vectors)
    for label, tile in block.tiles():
        other = np.flatnonzero(labels != label)
        right, near = system.take(block.vectors[tile].astype(np.int64)), block.ids[tile]
        for at in range(0, len(other), ANCHOR_TILE):
            some = other[at:at + ANCHOR_TILE]
            scores = system.scores([r[some] for r in residues], right)
            for k in range(POSITIVES):
                lo, hi = low[some, k, None], high[some, k, None]
                if (lo <= hi).any():
                    best[k].offer(some, np.where((scores >= lo) & (scores <= hi), scores, NONE), near)
    out = [b.rows() for b in best]
    anchor = pa.array(np.concatenate([a for a, _, _ in out]))
    place = np.concatenate([np.full(len(a), k, np.int32) for k, (a, _, _) in enumerate(out)])
    return pa.RecordBatch.from_arrays(
        [anchors.column(n).take(anchor) for n in ("row", "vec_id")] + [pa.array(place)]
        + [pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2)],
        names=["anchor_row", "anchor_id", "place", "negative_id", "negative_score"])


def _meeting(find, columns: int, largest: int):
    """Anchors of a partition against its blocks: rows of a block come first, then its anchors."""
    def run(parts):
        system, held, number, block = Residues(columns, largest), [], None, None
        for batch in parts:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if numbers[start] != number:
                    held, number, block = [], numbers[start], None
                if kinds[start] == 0:
                    held.append(piece)
                elif held or block is not None:
                    if block is None:
                        block, held = Block(held, columns), []
                    yield find(block, piece, unpacked(piece, columns), system)

    return run


def meet(rows: DataFrame, anchors: DataFrame, find, schema: str) -> DataFrame:
    """Results of ``find`` for every anchor with every block of rows."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("vector") / F.col("width")).alias("columns"),
                     F.max("squared").alias("squared")).first()
    columns, largest = int(stats.columns or 0), int(stats.squared or 0)
    blocks = max(MIN_BLOCKS, -(-stats.n * columns * 8 // BLOCK_BYTES))
    extra = [c for c in anchors.columns if c not in rows.columns]
    laid = rows.select("*", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra],
                       F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"))
    sent = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"))
    dealt = laid.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return batches.map_arrow(dealt, _meeting(find, columns, largest), schema)


def mine(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = whole_vectors(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0)
    near = meet(rows, anchors, find_positives, "anchor_row bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_row").orderBy(F.col("positive_score").desc(), "positive_id")
    first = near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < POSITIVES)
    positives = sized(first, "positives")
    windows = positives.groupBy("anchor_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positive_scores"))
    asking = anchors.join(windows, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    far = meet(rows, asking, find_negatives, "anchor_row bigint, anchor_id bigint, place int, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.join(positives.drop("anchor_id"), ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
          list_inner_product(a.vector, b.vector)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
far AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
        FROM positives p JOIN pairs USING (anchor_id)
        WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= {NEGATIVES}
"""
