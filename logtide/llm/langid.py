"""Language identification by compression (operator 3).

Every learned language has a zstandard raw-content dictionary: pieces of sample
texts of it, at most ``DICT_BYTES``. A text's lower-case words are compressed in blocks
with every dictionary; the language whose dictionary leaves the fewest bytes is the
prediction. Blocks keep a long text from drowning the dictionaries in its own repeats: all
of its blocks count, each by itself.

``score`` is the relative margin (second - best) / second in 0..1; with one
language the second is compression without a dictionary. A text whose margin is
below ``MARGIN``, or that has no letter, is rejected.

Null texts and texts without a letter: ``und``, score 0, rejected. Without any
labelled text every prediction is ``und``. Ties go to the first language in order.
The sample is bounded: ``SAMPLE_TEXTS`` texts a language, by hash of the text.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm import batches

#: Bounds of what is learned: texts a language, bytes a dictionary, bytes of a preferred sample text.
SAMPLE_TEXTS, DICT_BYTES, SHORT_TEXT = 80, 64 << 10, 4_000
#: Words of a sample's piece, bytes of a block, least relative margin.
PIECE, BLOCK, MARGIN = 12, 1_000, 0.002
#: A shorter text is repeated to this many bytes, so that it compresses at all.
SHORT_BLOCK = 160
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def sample(docs: DataFrame, usable: Column) -> dict[str, list[str]]:
    """Sample texts of each language, in order of their hash.

    The choice is made on hashes (a group limit before the shuffle, so a language with
    most rows sends ``SAMPLE_TEXTS`` rows a task); the chosen texts are then read by hash.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h"), (F.octet_length("text") > SHORT_TEXT).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", "h")
    picked = (rows.select("lang", "h", "long").distinct().withColumn("n", F.row_number().over(order))
              .filter(F.col("n") <= SAMPLE_TEXTS).select("lang", "h").collect())
    if not picked:
        return {}
    texts = rows.filter(F.col("h").isin([r.h for r in picked])).select("lang", "h", "text").distinct().collect()
    wanted = {(r.lang, r.h) for r in picked}
    found: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.h, r.text)):
        if (r.lang, r.h) in wanted:
            found.setdefault(r.lang, []).append(r.text)
    return found


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces(texts: list[str]) -> list[str]:
    """Pieces of ``PIECE`` words that share no six words in a row with another text.

    Passages that go round in a corpus say little of the language around them.
    """
    owners: dict[tuple, int] = {}
    listed = [words_of(t) for t in texts]
    for i, words in enumerate(listed):
        for k in range(len(words) - 5):
            key = tuple(words[k: k + 6])
            owners[key] = i if owners.get(key, i) == i else -1
    return [" ".join(words[k: k + PIECE]) for i, words in enumerate(listed) for k in range(0, len(words), PIECE)
            if all(owners.get(tuple(words[j: j + 6]), i) == i for j in range(max(0, k - 5), k + PIECE))]


def joined(parts: list[str]) -> bytes:
    """Whole pieces as far as the bound goes (a single longer one is cut there)."""
    out = b""
    for data in (p.encode() for p in parts):
        if out and len(out) + len(data) + 1 > DICT_BYTES:
            break
        out += data[:DICT_BYTES] + b"\n"
    return out


def dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """One dictionary a language, without pieces that read as another language.

    Each half of the sample is sifted by dictionaries made of the other half. A
    language that loses every piece keeps them all.
    """
    every = [(lang, t) for lang, texts in sorted(samples.items()) for t in texts]
    unique = set(pieces([t for _, t in every]))
    halves = [{lang: pieces(texts[h::2]) or [" ".join(words_of(t)) for t in texts[h::2]] for lang, texts in samples.items()}
              for h in (0, 1)]
    sifts = [Classifier({lang: joined(parts) for lang, parts in half.items()}) for half in halves]
    out = {}
    for lang in samples:
        mine = [p for h in (0, 1) for p in halves[h][lang] if p in unique and sifts[1 - h].predict(p)[0] == lang]
        out[lang] = joined(mine or [p for h in (0, 1) for p in halves[h][lang]])
    return out


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.languages = sorted(contents)
        self.coders = []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(contents[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=self.params())
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=self.params()))
        if len(self.coders) == 1:
            self.coders.append(zstandard.ZstdCompressor(compression_params=self.params()))

    @staticmethod
    def params() -> zstandard.ZstdCompressionParameters:
        """Greedy matches from 4 bytes on: short words already tell languages apart."""
        return zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        data = " ".join(words_of(text)).encode()
        if 0 < len(data) < SHORT_BLOCK:  # else it would be stored as it is, whatever the dictionary
            data = (data + b" ") * -(-SHORT_BLOCK // len(data))
        blocks = [data[i: i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.languages or not batches.LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best, second = sorted(sizes)[:2]
        at = sizes.index(best)
        language = self.languages[min(at, len(self.languages) - 1)]
        score = (second - best) / second
        return language, score, score < MARGIN


def _predicting(contents):
    classifier = Classifier(contents)

    def work(batch):
        rows = [classifier.predict(t) for t in batches.strings(batch)]
        kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        return kept | {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]}

    return work


def learn(docs: DataFrame, usable: Column):
    """Broadcast dictionaries: one a language, each within ``DICT_BYTES``."""
    return docs.sparkSession.sparkContext.broadcast(dictionaries(sample(docs, usable)))


def identify(docs: DataFrame, usable: Column, **kept: Column) -> DataFrame:
    """doc_id, kept columns, lang_pred, score, rejected; the scoring reads text alone."""
    rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in kept.items()])
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return batches.map_texts(rows, _predicting, schema, contents=learn(docs, usable))


def _keeping(contents):
    classifier = Classifier(contents)

    def work(batch):
        keep = [not classifier.predict(t)[2] for t in batches.strings(batch)]
        kept = batch.filter(keep)
        return dict(zip(kept.schema.names, kept.columns))

    return work


def accepted(docs: DataFrame, usable: Column) -> DataFrame:
    """The documents that are not rejected, with all their columns; no shuffle."""
    return batches.map_texts(docs, _keeping, docs.schema, contents=learn(docs, usable))
