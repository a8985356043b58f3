"""SentencePiece encoding and decoding (operator 1).

Unigram Viterbi: among all ways to write a text as pieces, the one with the
greatest sum of piece scores; of equal ones the one whose pieces start earliest.
Pieces and scores are a model file's own. They sit in a double-array trie: the
child of state s by character c is base[s] + c if check[base[s] + c] == s.
Spaces become the marker U+2581, and one stands before the text. A character that no
piece holds is written as its UTF-8 bytes, a byte piece each.

In these models a marker stands only at the start of a piece (checked on loading), so
no piece reaches over the beginning of a marked word, and none over a newline. The best path of
a text is the best paths of such stretches, one after another. Each distinct
stretch is solved once, many in lockstep.

Decoding joins the pieces, bytes as bytes, turns markers into spaces and takes off the
first one. It gives back every text but for markers in it, which come back as spaces.
Null and empty texts have no pieces.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm import batches

MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
UNKNOWN_PENALTY = 10.0
#: Stretches up to this length are solved in lockstep, others one by one.
LOCKSTEP = 128
#: Stretches times characters that are solved at once, at most: some arrays of 8 bytes a cell.
LOCKSTEP_CELLS = 400_000
#: Bytes of solved stretches that a task keeps, in each of two generations; a stretch and its ids
#: take about ``ENTRY_BYTES`` besides their contents.
KNOWN_BYTES, ENTRY_BYTES = 24 << 20, 240


class DoubleArray:
    """Trie over compact character codes; code 0 stands for all other characters."""

    def __init__(self, words: list[tuple[str, int]]):
        self.alphabet = {c: i for i, c in enumerate(sorted({c for w, _ in words for c in w}), 1)}
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for word, value in words:
            node = 0
            for c in word:
                code = self.alphabet[c]
                if code not in children[node]:
                    children[node][code] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][code]
            values[node] = value
        span = len(self.alphabet) + 1
        size = 4 * (len(children) + span)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = -2  # the root's own place
        place, lone, many = {0: 0}, span, 1
        for node, own in enumerate(children):  # a parent comes before its children
            codes = sorted(own)
            if not codes:
                continue
            if len(codes) == 1:  # any hole does
                while check[lone] != -1:
                    lone += 1
                start = lone - codes[0]
            else:  # both searches only move on, so building is linear but for collisions
                offsets = np.array(codes)
                while (check[many + offsets] != -1).any():
                    many += 1
                start = many
            base[place[node]] = start
            for code in codes:
                at = start + code
                check[at], value[at], place[own[code]] = place[node], values[own[code]], at
        used = int(np.flatnonzero(check != -1)[-1]) + span + 1
        self.base, self.check, self.value = base[:used], check[:used], value[:used]


class Codec:
    """Encoder and decoder of a model given as its file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)  # only reads the file here
        n = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        is_byte = [lib.is_byte(i) for i in range(n)]
        self.scores = np.array([lib.get_score(i) for i in range(n)])
        words = [(self.names[i], i) for i in range(n) if not special[i] and not is_byte[i] and not lib.is_unused(i)]
        if any(re.search(f"[^{MARK}]{MARK}|\n", w) for w, _ in words):
            raise ValueError("a piece reaches over the start of a word")
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if is_byte[i]}
        self.is_byte = np.array(is_byte)
        self.unknown_id = next((i for i in range(n) if lib.is_unknown(i)), 0)
        self.unknown = float(min(self.scores[i] for _, i in words)) - UNKNOWN_PENALTY
        self.output = [b"" if special[i] else bytes([int(self.names[i][3:5], 16)]) if is_byte[i]
                       else self.names[i].replace(MARK, " ").encode() for i in range(n)]
        self.trie = DoubleArray(words)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_bytes = 0

    def fallback(self, c: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def spell(self, stretch: str, path: list[tuple[int, int]]) -> bytes:
        """Ids of a path of (start, id) as int32; id -1 is a character of no piece."""
        ids = [k for start, i in path for k in ([i] if i >= 0 else self.fallback(stretch[start]))]
        return np.array(ids, np.int32).tobytes()

    def solve(self, stretch: str) -> bytes:
        """Best path of one stretch."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        codes = [self.trie.alphabet.get(c, 0) for c in stretch]
        best, came = [0.0] + [-np.inf] * len(codes), [(0, -1)] * (len(codes) + 1)
        for start in range(len(codes)):
            state, single = 0, False
            for end in range(start, len(codes)):
                nxt = base[state] + codes[end]
                if check[nxt] != state:
                    break
                state = nxt
                piece = value[state]
                if piece >= 0:
                    single |= end == start
                    score = best[start] + scores[piece]
                    if score > best[end + 1]:
                        best[end + 1], came[end + 1] = score, (start, int(piece))
            if not single and best[start] + self.unknown > best[start + 1]:
                best[start + 1], came[start + 1] = best[start] + self.unknown, (start, -1)
        path, at = [], len(codes)
        while at:
            path.append(came[at])
            at = came[at][0]
        return self.spell(stretch, path[::-1])

    def solve_many(self, stretches: list[str]) -> list[bytes]:
        """Best paths of stretches of similar length, one start position at a time."""
        trie, n = self.trie, len(stretches)
        sizes = np.fromiter(map(len, stretches), np.int64, n)
        width = int(sizes.max())
        codes = np.zeros((n, width + 1), np.int64)
        get = trie.alphabet.get
        codes[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes.tolist()])] = [get(c, 0) for c in "".join(stretches)]
        best, began = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        piece_at = np.full((n, width + 1), -1, np.int64)
        best[:, 0] = 0

        def offer(rows, start, end, scores, ids):
            better = scores > best[rows, end]
            rows = rows[better]
            best[rows, end], began[rows, end], piece_at[rows, end] = scores[better], start, ids[better]

        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            here, state = best[rows, start], np.zeros(len(rows), np.int64)
            single = np.zeros(len(rows), bool)
            live = np.arange(len(rows))
            for end in range(start, width):
                nxt = trie.base[state] + codes[rows[live], end]
                going = trie.check[nxt] == state
                live, state = live[going], nxt[going]
                if not len(live):
                    break
                ids = trie.value[state]
                found = ids >= 0
                if end == start:
                    single[live[found]] = True
                hit = live[found]
                offer(rows[hit], start, end + 1, here[hit] + self.scores[ids[found]], ids[found])
            alone = ~single
            offer(rows[alone], start, start + 1, here[alone] + self.unknown, np.full(int(alone.sum()), -1))
        # all paths from their ends, last piece first
        ids, starts = np.full((n, width), -2, np.int64), np.zeros((n, width), np.int64)
        at, step, rows = sizes.copy(), width, np.arange(n)
        while len(rows):
            step -= 1
            ids[rows, step], starts[rows, step] = piece_at[rows, at[rows]], began[rows, at[rows]]
            at[rows] = starts[rows, step]
            rows = rows[at[rows] > 0]
        rare = (ids == -1).any(axis=1)
        lengths = (ids > -2).sum(axis=1).tolist()
        flat = ids.astype(np.int32)
        return [flat[i, width - k:].tobytes() if not odd
                else self.spell(stretches[i], list(zip(starts[i, width - k:].tolist(), ids[i, width - k:].tolist())))
                for i, (k, odd) in enumerate(zip(lengths, rare.tolist()))]

    def learn(self, stretches: set[str]) -> None:
        """Solve stretches that are not known yet."""
        if self.known_bytes >= KNOWN_BYTES:
            self.known, self.older, self.known_bytes = {}, self.known, 0
        waiting, met = [], set()
        for s in stretches:
            if s not in self.known:
                met.add(s)
                if s in self.older:
                    self.known[s] = self.older[s]
                elif len(s) > LOCKSTEP:
                    self.known[s] = self.solve(s)
                else:
                    waiting.append(s)
        waiting.sort(key=len)
        at = 0
        while at < len(waiting):
            stop = at + 1
            longest = max(8, len(waiting[at]) * 5 // 4)
            while stop < len(waiting) and len(waiting[stop]) <= longest and (stop - at) * longest < LOCKSTEP_CELLS:
                stop += 1
            self.known.update(zip(waiting[at:stop], self.solve_many(waiting[at:stop])))
            at = stop
        self.known_bytes += sum(ENTRY_BYTES + 2 * len(s) + len(self.known[s]) for s in met)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        cut = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn({s for c in cut for s in c})
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """A worker's codec; the model stays between its tasks, solved stretches do not."""
    if hash(model) not in _codecs:
        _codecs.clear()
        _codecs[hash(model)] = Codec(model)
    return _codecs[hash(model)]


def _coding(model: bytes, with_text: bool):
    coder = codec(model)

    def work(batch):
        texts = batches.strings(batch)
        spelled = coder.encode_many(texts)
        values = np.frombuffer(b"".join(spelled), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(s) // 4 for s in spelled])]).astype(np.int32)
        bytes_so_far = np.concatenate([[0], np.cumsum(coder.is_byte[values])])
        every = values.tolist()
        decoded = [coder.decode(every[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        same = [d == (t if MARK not in t else t.replace(MARK, " ")) for d, t in zip(decoded, texts)]
        return {
            "doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "n_pieces": np.diff(offsets).astype(np.int64),
            "n_byte_pieces": np.diff(bytes_so_far[offsets]).astype(np.int64), "ids": pa.ListArray.from_arrays(offsets, values),
            "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded], "round_trip": same,
            **({"decoded": decoded} if with_text else {})}

    work.forget = coder.forget
    return work


def code_texts(docs: DataFrame, model_path: str, with_text: bool = False) -> DataFrame:
    """Ids of every document, and what they decode to (its digest, or the text too); no shuffle.

    The model file is read on the driver and sent out once; its size does not depend on the input.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    ids = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_texts(
        batches.id_text(docs), _coding,
        f"doc_id {ids}, n_chars bigint, n_pieces bigint, n_byte_pieces bigint, ids array<int>, decoded_sha256 string, "
        "round_trip boolean" + ", decoded string" * with_text, model=model, with_text=with_text)
