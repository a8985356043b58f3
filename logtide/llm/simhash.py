"""SimHash near-duplicates by deletion-variant signatures (operator 10).

A document's 64-bit fingerprint is the bitwise majority of the hashes of its
word shingles. Two fingerprints that differ in at most d bits, cut into
d // 2 + 1 segments, have a segment that differs in at most one bit. So each
distinct fingerprint is filed once for every bit position of every segment,
with that bit wiped out; an equality on (segment, position, rest) brings together all
that can be linked, and the exact distance decides.

Fingerprints that are equal become one before anything is filed. In a bucket,
links are not emitted pair by pair but as a spanning forest of them: a bucket
of m fingerprints yields fewer than m links however close they lie. In a large
bucket a member is compared with pivots first; two pivots' balls are compared
member by member only if they can touch and are not yet joined. Components
come from hooking, pointer doubling and contraction of the links.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a
fingerprint. A component whose ids are all null has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm import batches
from logtide.session import work_dir

BITS, SEED = 64, 42
#: Rows of one bucket that are compared row by offset; larger ones use pivots.
SMALL = 16


def fingerprint(text: str, width: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed=SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprinting(width: int):
    def work(batch):
        prints = np.array([fingerprint(t, width) for t in batches.strings(batch)], np.uint64)
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        return kept | {"fp": pa.array(prints.view(np.int64))}

    return work


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_texts(batches.id_text(docs), _fingerprinting, f"doc_id {ids}, fp bigint", width=width)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; enough that one differs in one bit at most."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: str, distance: int) -> Column:
    """Keys of one fingerprint: per bit, its segment without that bit, and the bit."""
    keys = []
    for first, bits in segments(distance):
        mask = ((1 << bits) - 1) << first
        for bit in range(first, first + bits):
            kept = mask & ~(1 << bit)
            signed = kept - (1 << 64) if kept >> 63 else kept
            keys.append(F.struct(F.lit(bit).cast("tinyint").alias("bit"),
                                 F.col(fp).bitwiseAND(F.lit(signed)).alias("rest")))
    return F.array(*keys)


class Forest:
    """Union-find over 0..n-1 that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


class RowForest(Forest):
    """A forest over row numbers of which few occur."""

    def __init__(self):
        self.parent, self.links = {}, []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i


def bucket_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, exact for any size.

    Each member joins the first pivot within ``distance``, or becomes one. Balls
    of pivots more than three distances apart cannot touch. Balls that could and are in
    different trees are compared in blocks, until they are joined or done.
    """
    forest, left, balls = Forest(len(members)), np.arange(len(members)), []
    while len(left):
        near = np.bitwise_count(members[left] ^ members[left[0]]) <= distance
        ball, left = left[near], left[~near]
        balls.append(ball)
        for other in ball[1:]:
            forest.join(int(ball[0]), int(other))
    pivots = members[[b[0] for b in balls]]
    for i, ball in enumerate(balls):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(pivots[i + 1:] ^ pivots[i]) <= 3 * distance):
            other = balls[j]
            if forest.root(int(ball[0])) == forest.root(int(other[0])):
                continue
            for k in ball:
                hit = np.flatnonzero(np.bitwise_count(members[other] ^ members[k]) <= distance)
                if len(hit):
                    forest.join(int(k), int(other[hit[0]]))
                    break
    return forest.links


def _linking(distance: int):
    def run(parts):
        key, held = None, np.empty(0, np.uint64)

        def emit(pairs):
            a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in zip(*pairs)) if pairs else ([], [])
            a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def links(bits, rest, fps):
            """Links of complete buckets in sorted rows."""
            out = []
            new = np.r_[True, (bits[1:] != bits[:-1]) | (rest[1:] != rest[:-1])]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, len(fps)])
            small = np.repeat(sizes <= SMALL, sizes)
            bucket = np.cumsum(new)
            pairs = []
            for step in range(1, min(SMALL, int(sizes.max()))):
                same = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:])
                same = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= distance]
                pairs += zip(same.tolist(), (same + step).tolist())
            forest = RowForest()
            for i, j in sorted(pairs):  # the least member's links first, so buckets agree on them
                forest.join(i, j)
            if forest.links:
                i, j = np.array(forest.links).T
                out.append((fps[i], fps[j]))
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                found = np.array(bucket_links(fps[s: s + n], distance), np.int64).reshape(-1, 2) + s
                out.append((fps[found[:, 0]], fps[found[:, 1]]))
            return out

        b, r, f = (np.empty(0, t) for t in (np.int8, np.int64, np.uint64))
        for part in parts:
            b = np.concatenate([b, part.column(0).to_numpy()])
            r = np.concatenate([r, part.column(1).to_numpy()])
            f = np.concatenate([f, part.column(2).to_numpy().view(np.uint64)])
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero((b != b[-1]) | (r != r[-1]))[-1]) + 1 if ((b != b[-1]) | (r != r[-1])).any() else 0
            if cut:
                yield emit(links(b[:cut], r[:cut], f[:cut]))
                b, r, f = b[cut:], r[cut:], f[cut:]
        if len(f):
            yield emit(links(b, r, f))

    return run


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links (a < b as longs) that connect all distinct ``fp`` within ``distance``.

    Not all pairs: in each bucket enough to connect what is linked. Links that several buckets
    find come once.
    """
    filed = (distinct.select("fp", F.explode(variants("fp", distance)).alias("k"))
             .select("k.bit", "k.rest", "fp").repartition("bit", "rest").sortWithinPartitions("bit", "rest", "fp"))
    return batches.map_arrow(filed, _linking(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): smallest vertex of each component, for every vertex of an edge.

    Each round hooks every vertex to its least neighbour, follows the hooks to their ends
    by doubling, and contracts: edges are drawn between the ends, and those
    within one tree fall away. So the joins shrink with the edges that are left.
    Every step is written to the shared folder: lineage stays short and lost executors
    cost no more than a step.
    """
    spark, folder = edges.sparkSession, work_dir(edges.sparkSession, "components")
    steps = iter(range(1_000_000))

    def written(frame: DataFrame) -> DataFrame:
        path = f"{folder}/{next(steps)}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    left, labels = written(edges.select("a", "b")), None
    while True:
        both = left.union(left.select("b", "a")).toDF("v", "w")
        ends = written(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("end")))
        while True:
            further = written(ends.join(ends.toDF("end", "next"), "end").select("v", F.col("next").alias("end"), (F.col("next") < F.col("end")).alias("moved")))
            ends = further.select("v", "end")
            if further.filter("moved").isEmpty():
                break
        labels = ends.toDF("v", "root") if labels is None else labels.join(ends.toDF("root", "end"), "root", "left").select(
            "v", F.coalesce("end", "root").alias("root"))
        labels = written(labels)
        left = written(left.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.isEmpty():
            return labels


def class_of_fingerprint(prints: DataFrame, distance: int) -> DataFrame:
    """fp, root (least fingerprint of its component), component_id (least doc_id)."""
    spark, folder = prints.sparkSession, work_dir(prints.sparkSession, "simhash")
    prints.groupBy("fp").agg(F.min("doc_id").alias("least")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    roots = components(links(distinct, distance)).toDF("fp", "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, root, component_id of every document.

    Fingerprints are written once (16 bytes a document), as they are read twice.
    The join on fp meets hot fingerprints as rows of 16 bytes on one side and one row on
    the other, which adaptive execution splits.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "fingerprints")
    fingerprints(docs, width).write.parquet(folder)
    prints = spark.read.parquet(folder)
    return prints.join(class_of_fingerprint(prints, distance), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each near-duplicate group: least doc_id (nulls last), then least text hash, row hash.

    Rows are written with their fingerprint and a number of their own, so that of
    rows equal in everything one stays too. The choice is made on narrow keys: a
    window would gather a group in one task.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "dedup")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text",
                        F.monotonically_increasing_id().alias("number"))
    schema = whole.select("row", "doc_id", "number").schema.add("fp", "long")
    batches.map_texts(whole, _fingerprinting, schema, width=width).write.parquet(folder)
    rows = spark.read.parquet(folder)
    narrow = rows.select("fp", "doc_id", "number", F.xxhash64("row.text").alias("text_hash"), F.xxhash64("row").alias("row_hash"))
    classes = class_of_fingerprint(narrow.select("fp", "doc_id"), distance).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_hash", "number")
    first = narrow.join(classes, "fp").groupBy("root").agg(F.min(order)["number"].alias("number"))
    return rows.join(first.select("number"), "number", "left_semi").select("row.*")
