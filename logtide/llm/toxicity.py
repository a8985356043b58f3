"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Toxic and ordinary texts each give a character model of words. A character's
probability after the five before it in its word is interpolated Kneser-Ney:
counts of the class at the orders 6 to ``SHARED`` + 1 (below 6 the number of different
characters seen in front), below that the counts of both classes together. So
what one class has seen and the other never did tells them apart, while rare expressions
that neither knows well fall back on shared counts and tell nothing.

A word's evidence is its toxic log-likelihood less its ordinary one, divided by its
length. In scoring, what speaks for toxic counts by its support: a character whose n-gram
stands in n labelled toxic documents has n^2 / (n^2 + ``DOUBT``) of its log-ratio, so a clean
word that one or two toxic texts happen to hold is no insult. What speaks against counts in full. A text is as toxic as its worst word: a mean over a long text would drown
one insult. The score is logistic in that evidence. All words of a text count,
each once; counts are numbers of documents, so a repeated line adds nothing.

What the models gather is every labelled document's n-grams, summed in Spark. For scoring
they go into tables of fixed size (n-grams modulo a prime for each order), which bounds what is
sent to the tasks whatever the corpus.

Null and empty texts have no evidence (0). Labels of one id that differ count as
toxic; null labels do not count. Without labels of both classes all evidence is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm import batches
from logtide.session import work_dir

ORDER, SHARED, BITS, DISCOUNT = 6, 1, 10, 0.75
#: Evidence per character at which the score is one half, its slope, and the score of a rejected text.
MIDDLE, SLOPE, REJECT = 1.5, 4.0, 0.7
#: Square of the number of toxic documents at which an n-gram has half its weight.
DOUBT = 12
#: Places of the table of each order: primes far from powers of two, as n-grams are packed by bits.
PLACES = {6: 15_485_863, 5: 7_368_787, 4: 3_497_861, 3: 1_299_709, 2: 104_729, 1: 1_223, 0: 1}
#: Counts are kept in a byte: 0, or 1 plus eight times the binary logarithm.
COUNTS = np.concatenate([[0], 2.0 ** (np.arange(255) / 8)])
WORD = re.compile(r"[^\W_]+")
END = "\x01"


def character_codes(text: str) -> np.ndarray:
    """Characters in ``BITS`` bits: digits as one, rare alphabets folded."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[(points >= 48) & (points < 58)] = 48
    return np.where(points < 1024, points, 512 + (points * 40_503 >> 4) % 512)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, first n-gram of each word, n-grams of each word).

    An n-gram holds a character (or the word's end) and the five before it within the word.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = character_codes(END.join(words) + END)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    grams = codes.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(codes)
        before[back:] = codes[:-back]
        before[place < back] = 0
        grams |= before << (BITS * back)
    return grams, starts, sizes


def low(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _gathering(parts):
    """(gram, ordinary, toxic): documents of each class by n-gram, summed within a slice."""
    for part in parts:
        for piece in batches.slices(part, "text"):
            texts, toxic = batches.strings(piece), np.array(piece.column("toxic").to_pylist(), np.int64)
            found = [list(set(WORD.findall(t.lower()))) for t in texts]
            words = [w for ws in found for w in ws]
            if not words:
                continue
            grams, _, sizes = word_grams(words)
            classes = np.repeat(np.repeat(toxic, [len(ws) for ws in found]), sizes)
            unique, where = np.unique(grams, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique), *[pa.array(np.bincount(where[classes == k], minlength=len(unique))) for k in (0, 1)]],
                names=["gram", "n0", "n1"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """All n-grams of the labelled texts with their counts by class, written once."""
    folder = work_dir(labelled.sparkSession, "grams")
    gathered = batches.map_arrow(labelled, _gathering, "gram bigint, n0 bigint, n1 bigint")
    gathered.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).write.parquet(folder)
    return labelled.sparkSession.read.parquet(folder)


def byte_of(count: Column) -> Column:
    return F.when(count > 0, F.round(8 * F.log2(count)) + 1).otherwise(0).cast("smallint")


def tables(grams: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Arrays (2 classes x places) of bytes: "count" of an order's n-grams, "sum" and "kinds" of its contexts.

    Every frame is summed by place before it is read: at most ``PLACES`` rows of
    some bytes. Two n-grams in one place are counted together.
    """
    out = {}

    def read(name: tuple, frame: DataFrame, places: int) -> None:
        rows = frame.toArrow()
        for n in name:
            array = out[n, order] = np.zeros((2, places), np.uint8)
            for k in (0, 1):
                array[k, rows.column("place").to_numpy()] = rows.column(f"{n}{k}").to_numpy().astype(np.uint8)

    for order in range(ORDER, 0, -1):
        seen = [(F.col(f"n{k}") > 0).cast("bigint") for k in (0, 1)]
        if order < ORDER:
            counts = [F.sum(s) for s in seen] if order > SHARED else [F.count("*"), F.count("*")]
            grams = grams.groupBy(F.col("gram").bitwiseAND(F.lit(low(order))).alias("gram")).agg(
                *[c.alias(f"n{k}") for k, c in enumerate(counts)])
        own, context = F.col("gram") % PLACES[order], F.shiftright("gram", BITS) % PLACES[order - 1]
        read(("count",), grams.groupBy(own.cast("int").alias("place")).agg(
            *[byte_of(F.sum(f"n{k}")).alias(f"count{k}") for k in (0, 1)]), PLACES[order])
        read(("sum", "kinds"), grams.groupBy(context.cast("int").alias("place")).agg(
            *[byte_of(F.sum(f"n{k}")).alias(f"sum{k}") for k in (0, 1)],
            *[byte_of(F.sum(s)).alias(f"kinds{k}") for k, s in enumerate(seen)]), PLACES[order - 1])
    return out


def packed(stored: dict[tuple[str, int], np.ndarray]) -> dict:
    """Tables as compressed bytes: mostly empty ones stay small on their way to the tasks."""
    return {key: zstandard.compress(array.tobytes(), 1) for key, array in stored.items()}


class Model:
    def __init__(self, stored: dict):
        self.stored = {key: np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, -1) for key, data in stored.items()}

    def character_ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log-ratio of each character, toxic count of its n-gram, first character and size of each word)."""
        grams, starts, sizes = word_grams(words)
        p = [np.full(len(grams), 1 / (1 << BITS)) for _ in (0, 1)]
        for order in range(1, ORDER + 1):
            part = grams & low(order)
            own, context = part % PLACES[order], (part >> BITS) % PLACES[order - 1]
            for k in (0, 1):
                count, total, kinds = (COUNTS[self.stored[name, order][k, at]] for name, at in (
                    ("count", own), ("sum", context), ("kinds", context)))
                known = total > 0
                scale = 1 / np.where(known, total, 1)
                p[k] = np.maximum(count - DISCOUNT, 0) * scale + np.where(known, DISCOUNT * kinds * scale, 1) * p[k]
        seen = COUNTS[self.stored["count", ORDER][1, grams % PLACES[ORDER]]]
        return np.log(p[1]) - np.log(p[0]), seen, starts, sizes

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, by its length."""
        ratios, _, starts, sizes = self.character_ratios(words)
        return np.add.reduceat(ratios, starts) / sizes

    def supported_evidence(self, words: list[str]) -> np.ndarray:
        """Word evidence in which a positive ratio counts by the toxic documents behind it."""
        ratios, seen, starts, sizes = self.character_ratios(words)
        weighed = np.where(ratios > 0, ratios * seen**2 / (seen**2 + DOUBT), ratios)
        return np.add.reduceat(weighed, starts) / sizes

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Greatest word evidence of each text; 0 without words."""
        found = [set(WORD.findall(t.lower())) for t in texts]
        words = list(set().union(*found))
        if not words:
            return np.zeros(len(texts))
        known = dict(zip(words, self.supported_evidence(words).tolist()))
        return np.array([max(map(known.__getitem__, ws), default=0.0) for ws in found])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-SLOPE * (self.evidence(texts) - MIDDLE)))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """text and toxic of the documents that may be learned from.

    Both sides go by id at any size, so that the plan measured is the plan at scale; only
    the labels of a partition are held in memory and the texts are not sorted.
    """
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).hint("shuffle_hash")
    return (docs.select("doc_id", "text").filter(usable & F.col("text").isNotNull())
            .join(known, F.col("doc_id") == F.col("label_id")).select("text", "toxic"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column):
    """Broadcast model tables (at most about 110 MB, for any corpus)."""
    stored = packed(tables(gram_counts(labelled(docs, labels, usable))))
    return docs.sparkSession.sparkContext.broadcast(stored)


def _scoring(stored):
    model = Model(stored)

    def work(batch):
        scores = model.scores(batches.strings(batch))
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        return kept | {"score": scores, "predicted": (scores >= REJECT).astype(np.int32)}

    return work


def score(docs: DataFrame, labels: DataFrame, usable: Column, **kept: Column) -> DataFrame:
    """doc_id, kept columns, score, predicted; the scoring reads text alone."""
    rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in kept.items()])
    schema = rows.drop("text").schema.add("score", "double").add("predicted", "integer")
    return batches.map_texts(rows, _scoring, schema, stored=learn(docs, labels, usable))


def _keeping(stored):
    model = Model(stored)

    def work(batch):
        kept = batch.filter(pa.array(model.scores(batches.strings(batch)) < REJECT))
        return dict(zip(kept.schema.names, kept.columns))

    return work


def accepted(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The documents that are not rejected, with all their columns; one pass, no shuffle of them."""
    return batches.map_texts(docs, _keeping, docs.schema, stored=learn(docs, labels, usable))
