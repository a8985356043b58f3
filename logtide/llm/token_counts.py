"""Token counts by a compiled word transducer (operator 8).

A word's BPE encoding is built from left to right: the encoding of a prefix
ends in exactly one token t such that what stands before t is itself encoded,
ending in u, and u, t do not merge with each other. So a state need only hold, for
every start that some token still reaches over, the last token before it and
the token count there, relative to the present one. There are finitely many
such states. They are compiled when first met into deterministic transitions
(state, character) -> (state, tokens emitted); the end of a word emits the rest.

White space always leads back to the start state. A stretch of text is
therefore a state map that is known from three things: what stands before its first
white space, the tokens between its first and last, what stands after its last.
Such maps compose associatively, so long texts are cut anywhere, the parts
mapped by themselves, and the maps composed by a prefix scan.

Null texts count as empty (0 tokens). Equal rows give equal rows.
"""

from __future__ import annotations

import json
import unicodedata
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from logtide.llm import batches

#: Characters in a stretch of text that is mapped by itself.
STRETCH = 1 << 16
#: Compiled transitions and words kept in a Python worker before it starts anew.
MOST_STEPS, MOST_WORDS = 500_000, 250_000
END = "</w>"
SPACE = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
GAP = regex.compile(f"[{SPACE}]")
#: Characters that str.split() takes for white space and the vocabulary does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTransducer:
    """Tokens of one word, by transitions compiled when first needed."""

    def __init__(self, vocab: list[str], merges: list[tuple[str, str]]):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.tokens = list(vocab)
        self.children: list[dict[str, int]] = [{}]
        self.plain, self.final = [-1], [-1]
        for number, token in enumerate(self.tokens):
            ends = token.endswith(END)
            node = 0
            for c in token[: -len(END)] if ends else token:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.plain.append(-1)
                    self.final.append(-1)
                node = nxt
            if node:
                (self.final if ends else self.plain)[node] = number
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: dict[int, int] = {}
        self.compiled = 0

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """BPE of a few symbols by its definition: lowest rank first, from the left."""
        while len(parts) > 1:
            ranked = [(self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.rank):
                break
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
        return parts

    def stays(self, before: int, token: int) -> bool:
        """Whether the two tokens, next to each other, are their own encoding."""
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 2 * MOST_STEPS:
                self.pairs.clear()
            want = [self.tokens[t] for t in key if t >= 0]
            known = self.pairs[key] = self.merged([s for t in want for s in self.symbols(t)]) == want
        return known

    def compile(self, state: int, c: str) -> tuple[int, int]:
        found, live = None, []
        for node, last, count in self.states[state]:
            child = self.children[node].get(c)
            if child is None:
                continue
            token = self.plain[child]
            if found is None and token >= 0 and self.stays(last, token):
                found = (token, count + 1)
            if self.children[child] or self.final[child] >= 0:
                live.append((child, last, count))
        token, emitted = found
        target = (*((n, l, k - emitted) for n, l, k in live), (0, token, 0))
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
            self.steps.append({})
        self.compiled += 1
        self.steps[state][c] = number, emitted
        return number, emitted

    def finish(self, state: int) -> int:
        for node, last, count in self.states[state]:
            token = self.final[node]
            if token >= 0 and self.stays(last, token):
                return count + 1
        raise ValueError("no encoding")

    def count(self, word: str) -> int:
        """Tokens of a word given in byte letters."""
        if self.compiled > MOST_STEPS:
            self.reset()
        state, total, steps = 0, 0, self.steps
        for c in word:
            state, emitted = steps[state].get(c) or self.compile(state, c)
            total += emitted
        rest = self.ends.get(state)
        if rest is None:
            rest = self.ends[state] = self.finish(state)
        return total + rest


class Span(NamedTuple):
    """State map of a stretch of text. ``gap`` false: all of it is ``head``."""

    head: str
    tokens: int
    tail: str
    gap: bool


class Counter:
    """Token counts of whole texts for a vocabulary file given as bytes."""

    def __init__(self, model: bytes):
        spec = json.loads(model)
        parts = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in parts["merges"]]
        self.words = WordTransducer(list(parts["vocab"]), merges)
        self.letters = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of lower-case text without white space."""
        total = self.older.get(text)
        if total is not None:
            self.known[text] = total
            return total
        if len(self.known) >= MOST_WORDS:
            self.known, self.older = {}, self.known
        total = 0
        for piece in PIECE.findall(text):
            plain = piece.isascii() and piece.isprintable()
            total += self.words.count(piece if plain else piece.encode().decode("latin-1").translate(self.letters))
        self.known[text] = total
        return total

    def closed(self, text: str) -> int:
        """Tokens of text between white space (or the ends of the text)."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # the vocabulary's lower case knows no final form
        units = GAP.split(text.lower()) if SEPARATORS.search(text) else text.lower().split()
        counts = list(map(self.known.get, units))
        if None in counts:
            counts = [self.unit(u) if n is None else n for u, n in zip(units, counts)]
        return sum(counts)

    def span(self, text: str) -> Span:
        first = GAP.search(text)
        if first is None:
            return Span(text, 0, "", False)
        last = len(text)
        while not GAP.match(text, last - 1):
            last -= 1
        return Span(text[: first.start()], self.closed(text[first.start(): last]), text[last:], True)

    def compose(self, a: Span, b: Span) -> Span:
        if not a.gap:
            return Span(a.head + b.head, b.tokens, b.tail, b.gap)
        if not b.gap:
            return Span(a.head, a.tokens, a.tail + b.head, True)
        return Span(a.head, a.tokens + self.closed(a.tail + b.head) + b.tokens, b.tail, True)

    def scan(self, spans: list[Span]) -> Span:
        """Composition of all maps, pair by pair, in log2 rounds."""
        while len(spans) > 1:
            pairs = [self.compose(*spans[i: i + 2]) for i in range(0, len(spans) - 1, 2)]
            spans = pairs + spans[len(pairs) * 2:]
        return spans[0]

    def plain(self, text: str, stretch: int = STRETCH) -> int:
        if len(text) <= stretch:
            return self.closed(text)
        whole = self.scan([self.span(text[i: i + stretch]) for i in range(0, len(text), stretch)])
        return self.closed(whole.head) + whole.tokens + (self.closed(whole.tail) if whole.gap else 0)

    def count(self, text: str, stretch: int = STRETCH) -> int:
        """All tokens; the vocabulary's special strings count as one each."""
        if self.special is None or not self.special.search(text):
            return self.plain(text, stretch)
        return len(self.special.findall(text)) + sum(self.plain(p, stretch) for p in self.special.split(text))


_counters: dict[int, Counter] = {}


def _counting(model: bytes, limit: int):
    counter = _counters.get(hash(model))  # a worker that is used again keeps its transitions
    if counter is None:
        _counters.clear()
        counter = _counters[hash(model)] = Counter(model)

    def work(batch):
        texts = batches.strings(batch)
        counts = [counter.count(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return work


def count_tokens(docs: DataFrame, model_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; no shuffle.

    The vocabulary file is read on the driver and sent out once; its size is
    that of the published file, whatever the input.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    ids = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_texts(batches.id_text(docs), _counting,
                             f"doc_id {ids}, n_bytes bigint, n_tokens bigint, over_limit boolean",
                             model=model, limit=limit)
