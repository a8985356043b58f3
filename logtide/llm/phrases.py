"""Document fingerprints by locally consistent parsing (operator 5).

A text is read as its UTF-8 bytes. Each round names phrases of the sequence and
hands the names on as the next sequence:

1. deterministic coin tossing: a symbol's label is the lowest bit in which it
   differs from its left neighbour, with the bit's value. Two more tosses bring
   the labels below 9 and keep unequal neighbours apart. Within a run of one
   symbol nothing differs and the label is one that no other symbol has;
2. a phrase begins at each local maximum of the labels (a plateau's first), so a
   run stays within one phrase. A phrase's name is a hash of its symbols in order.

Where a phrase begins depends on a few symbols around it alone, so equal substrings
have equal phrases but for the edges, at any offset. After four rounds a phrase spans
some words. A fingerprint is the least 64 of a text's phrase names, each
as 32 bits, after a mix; likeness is the share of the least 64 of both together
that both have, an estimate of the Jaccard likeness of their phrase sets. Short
texts use earlier rounds as well: names of all rounds from the second are kept in the set.

Texts of many documents are parsed in one array; every document starts a phrase.
Null texts count as empty; empty texts have an empty fingerprint, and two of
them are alike (1.0), an empty and another text not at all (0.0).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm import batches

ROUNDS, FIRST_ROUND, KEEP = 4, 2, 64
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a range of the documents' order.
RANGE_ROWS = 5_000
#: Most ranges, and so most bounds that the driver sees.
MOST_RANGES = 20_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def tosses(width: int) -> np.ndarray:
    """Label of (symbol, left neighbour) for symbols below 2 ** width, as a table.

    Equal symbols have no differing bit; their label is 2 * width.
    """
    size = 1 << width
    a, b = np.arange(size)[:, None], np.arange(size)[None, :]
    low = (a ^ b) & -(a ^ b)
    bit = np.log2(np.maximum(low, 1)).astype(np.int64)
    return np.where(a == b, 2 * width, 2 * bit + ((a >> bit) & 1)).astype(np.uint8).ravel()


BYTE, SIX, FIVE, FOUR = tosses(8), tosses(6), tosses(5), tosses(4)
#: Lowest set bit of 16-bit words; 16 for zero.
LOWEST = np.array([16] + [(i & -i).bit_length() - 1 for i in range(1, 1 << 16)], np.uint8)


def toss_words(names: np.ndarray, left: np.ndarray) -> np.ndarray:
    """First toss of 64-bit names, by their low 16 bits (labels below 34)."""
    low = names.astype(np.uint16)
    bit = LOWEST[low ^ left.astype(np.uint16)]
    return 2 * bit + ((low >> np.minimum(bit, 15)) & 1).astype(np.uint8)


#: Odd factors by place in a phrase, and first names of the bytes.
PLACE = mix(np.arange(1, 1025, dtype=np.uint64) * STEP) | np.uint64(1)
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def left_of(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Left neighbours; a document's first symbol has 0."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[starts] = 0
    return left


def pair(x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Each label with its left neighbour as an index into a toss table."""
    return (x.astype(np.uint16) << np.uint16(width)) | left_of(x, starts)


def parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: names of the phrases, and where each document's begin.

    ``starts``: first symbol of each document; none is empty.
    """
    if symbols.dtype == np.uint8:
        labels = FIVE[pair(BYTE[pair(symbols, starts, 8)], starts, 5)]  # below 17, then 11
        words = BYTE_NAMES[symbols]
    else:
        labels = SIX[pair(toss_words(symbols, left_of(symbols, starts)), starts, 6)]  # below 34, then 13
        words = symbols
    labels = FOUR[pair(labels, starts, 4)]  # below 9
    right = np.empty_like(labels)
    right[:-1] = labels[1:]
    right[starts[1:] - 1] = right[-1] = 255  # a last symbol begins no phrase
    cut = (labels > left_of(labels, starts)) & (labels >= right)
    cut[starts] = True
    first = np.flatnonzero(cut)
    place = np.arange(len(symbols)) - np.repeat(first, np.diff(np.append(first, len(symbols))))
    names = mix(np.add.reduceat(words * PLACE[place & (len(PLACE) - 1)], first))
    return names, np.searchsorted(first, starts)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """Least ``KEEP`` distinct 32-bit names of each text, ascending."""
    full = [i for i, t in enumerate(texts) if t]
    out = [np.empty(0, np.uint32)] * len(texts)
    if not full:
        return out
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0] + [len(texts[i]) for i in full[:-1]])
    found, owners = [], []
    for turn in range(1, ROUNDS + 1):
        symbols, starts = parse(symbols, starts)
        if turn >= FIRST_ROUND:
            found.append(mix(symbols + np.uint64(turn)) >> np.uint64(32))
            owners.append(np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(starts, len(symbols)))))
    keys = np.unique((np.concatenate(owners) << np.uint64(32)) | np.concatenate(found))
    ends = np.searchsorted(keys, np.arange(len(full) + 1, dtype=np.uint64) << np.uint64(32))
    names = keys.astype(np.uint32)
    for k, i in enumerate(full):
        out[i] = names[ends[k]: min(ends[k] + KEEP, ends[k + 1])]
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEEP]
    return float(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).size / both.size)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"),
                              "fingerprint": list(map(text_of, sketches([t.encode() for t in batches.strings(batch)])))}

    return batches.map_texts(batches.id_text(docs), make, f"doc_id {ids}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _comparing(parts):
    """Rows of whole ranges in order, each with the one after it; guests end a range."""
    held = None
    for part in parts:
        for piece in batches.slices(part, "text"):
            texts = batches.strings(piece)
            prints = sketches([t.encode() for t in texts])
            rows = list(zip(piece.column("doc_id").to_pylist(), texts, prints, piece.column("guest").to_pylist(),
                            piece.column("range").to_pylist()))
            rows = rows if held is None else [held, *rows]
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
            changed = [edited(a[1], b[1]).encode() for a, b in pairs]
            after = sketches(changed)
            columns = {
                "doc_id": [a[0] for a, _ in pairs],
                "n_chars": [len(a[1]) for a, _ in pairs],
                "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
                "fingerprint": [text_of(a[2]) for a, _ in pairs],
                "edited_fingerprint": list(map(text_of, after)),
                "near_edited": [likeness(a[2], c) for (a, _), c in zip(pairs, after)],
                "near_next": [likeness(a[2], b[2]) for a, b in pairs],
            }
            kinds = [part.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], names=list(columns))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below the key, by a two-step search."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds)) + 1
    groups = [bounds[i: i + size] for i in range(0, len(bounds), size)]
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    return F.when(group > 0, (group - 1) * size + below(inner)).otherwise(0)


def real_bounds(ids: DataFrame, quantiles: list[float], least: int) -> list[int]:
    """The least id of each range between quantiles, ascending, without the least of all.

    Quantiles are doubles: beyond 2^53 they need not be ids of the table.
    """
    rough = sorted({min(int(q), (1 << 63) - 1) for q in quantiles} - {least})
    found = ids.filter("k is not null").groupBy(range_of(F.col("k"), rough).alias("r")).agg(F.min("k").alias("k")).collect()
    return sorted({r.k for r in found} - {least})


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and the next document's.

    Order is doc_id (an integer; nulls first), then text. The next of the last row is the
    first; a single row is its own next. Whole texts move once, to ranges of
    about ``RANGE_ROWS`` rows (more beyond ``MOST_RANGES``) whose bounds are read
    from the ids alone, in two passes as quantiles are doubles. A bound is an id of the table, so the first row of a range is
    known by its id; a copy of it goes to the range before, as a guest.
    Rows that share an id share a range; ids are meant to be unique.
    """
    narrow = batches.id_text(docs)
    key = F.col("doc_id").cast("bigint")
    ids = narrow.select(key.alias("k"))
    rows, known, least = ids.agg(F.count("*"), F.count("k"), F.min("k")).first()
    ranges = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    wanted = [i / ranges for i in range(1, ranges)]
    bounds = real_bounds(ids, ids.approxQuantile("k", wanted, 0.25 / ranges), least) if wanted and known else []
    place = range_of(key, bounds)
    head = key.isin(bounds) if len(bounds) < 50 else F.element_at(F.array(*map(F.lit, bounds)), F.greatest("r", F.lit(1))) == key
    first = key.isNull() if known < rows else key == F.lit(least)
    copies = F.array_compact(F.array(
        F.struct(F.col("r").alias("range"), F.lit(False).alias("guest")),
        F.when((F.col("r") > 0) & head, F.struct((F.col("r") - 1).alias("range"), F.lit(True).alias("guest"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("range"), F.lit(True).alias("guest")))))
    dealt = (narrow.withColumn("r", F.coalesce(place, F.lit(0)))
             .select("doc_id", "text", F.explode(copies).alias("c"))
             .select("doc_id", "text", "c.range", "c.guest"))
    sorted_rows = dealt.repartition("range").sortWithinPartitions("range", "guest", "doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return batches.map_arrow(sorted_rows, _comparing, f"doc_id {kind}, {SCHEMA}")
