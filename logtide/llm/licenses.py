"""License scans (operator 9).

An Aho-Corasick automaton runs once over the words of a text, joined by single
spaces, and finds notice phrases wherever their words stand consecutively.
Licence tags (``SPDX-License-Identifier:``) are found by a second automaton over the
lower-case text; the expression that follows goes through a shunting-yard parser
(WITH binds tighter than AND, AND tighter than OR) whose value is both the set
of licence names and how freely the text may be used.

``score`` is that freedom from 0 (no licence found) to 1: OR takes the freest
operand, AND the strictest, WITH gives an exception's tenth on top. A document's
notices and expressions all hold, so its score is the least of them. Whatever stands
first after a tag, after an operator in capitals or within brackets is a name, save
NONE and NOASSERTION; after another operator only a known family or what has a digit or
hyphen, as prose may follow. Names that are not in ``FREEDOM`` count 0.2. A full stop
after a name ends its expression. An expression that does not parse gives no
label and no score.

Null texts count as empty: no words, no labels, score 0.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from logtide.llm import batches

# Phrases that count as places, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases, labels only.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
# Freedom of use by label.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "bsl": 0.9, "apache": 0.9,
    "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.2
TAGS = ("spdx-license-identifier:", "license-expression:")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}
#: SPDX values that say that no licence is named.
NO_NAMES = {"none", "noassertion"}
SHORT_NAME = re.compile(r"^(cc-by(?:-nc)?(?:-sa|-nd)?|[a-z0-9]+(?=[-+]|$))")


def label_of(name: str) -> str:
    """Label of a licence identifier: its family, without version and suffix."""
    name = name.rstrip("+")
    if name.startswith("cc0"):
        return "cc0"
    found = SHORT_NAME.match(name)
    return found.group(1) if found else name


def is_name(token: str) -> bool:
    """A known family, or what looks like an identifier; other words are prose."""
    return label_of(token) in FREEDOM or bool(re.search(r"[\d-]", token))


def tokens_of(line: str) -> list[str]:
    """Expression tokens, in lower case, up to the first thing that cannot belong to one."""
    lower = line.translate(LOWER)
    out, at, after_name, depth, any_name = [], 0, False, 0, True
    while found := TOKEN.match(lower, at):
        token = found.group(1).rstrip(".:")
        # a name can follow only an operator or "(", so prose after it ends the expression
        if token == "(" and after_name or token == ")" and not depth:
            break
        if token not in BINDS and token not in "()" and (
                after_name or token in NO_NAMES or not (any_name or depth or is_name(token))):
            break
        depth += (token == "(") - (token == ")")
        after_name = token not in BINDS and token != "("
        any_name = token in BINDS and line[found.start(1): found.start(1) + len(token)].isupper()
        out.append(token)
        at = found.end()
        if found.group(1).endswith(".") and not lower.startswith(")", at):
            break
    while out and out[-1] in BINDS:
        out.pop()
    return out


def evaluate(tokens: list[str]) -> tuple[frozenset[str], float] | None:
    """(labels, freedom) of an expression; None if it is malformed."""
    values: list[tuple[frozenset[str], float]] = []
    waiting: list[str] = []

    def apply(operator: str) -> bool:
        if operator not in BINDS or len(values) < 2:
            return False
        (right, right_free), (left, left_free) = values.pop(), values.pop()
        if operator == "with":
            values.append((left, min(1.0, left_free + 0.1)))
        else:
            pick = max if operator == "or" else min
            values.append((left | right, pick(left_free, right_free)))
        return True

    operand_next = True
    for token in tokens:
        if operand_next != (token not in BINDS and token != ")"):
            return None
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                if not apply(waiting.pop()):
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif token in BINDS:
            while waiting and BINDS.get(waiting[-1], 0) >= BINDS[token]:
                if not apply(waiting.pop()):
                    return None
            waiting.append(token)
            operand_next = True
        else:
            label = label_of(token)
            values.append((frozenset([label]), FREEDOM.get(label, UNKNOWN)))
            operand_next = False
    while waiting:
        if not apply(waiting.pop()):
            return None
    return values[0] if len(values) == 1 and not operand_next else None


class Scanner:
    """All findings of one text."""

    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in {**BASE, **NOTICES}.items():
            self.phrases.add_word(f" {phrase} ", (phrase in BASE, len(phrase), label))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def expressions(self, text: str, lower: str) -> list[tuple[frozenset[str], float]]:
        found = []
        for end, _ in self.tags.iter(lower):
            stop = text.find("\n", end + 1)
            value = evaluate(tokens_of(text[end + 1: stop if stop >= 0 else len(text)]))
            if value:
                found.append(value)
        return found

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        lower = text.translate(LOWER)
        words = WORD.findall(lower)
        joined = f" {' '.join(words)} "
        places, base, labels, notices = [], set(), set(), {}
        for end, (is_base, length, label) in self.phrases.iter(joined):
            labels.add(label)
            start = end - length
            # a longer notice that starts at the same word says more than a shorter one
            notices[start] = max(notices.get(start, (0, "")), (length, label))
            if is_base:
                places.append(start)
                base.add(label)
        free = [FREEDOM.get(label, UNKNOWN) for _, label in notices.values()]
        for names, freedom in self.expressions(text, lower):
            labels |= names
            free.append(freedom)
        first = joined.count(" ", 0, min(places)) - 1 if places else None
        last = joined.count(" ", 0, max(places)) - 1 if places else None
        return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                min(free, default=0.0))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _scanning():
    scanner = Scanner()

    def work(batch):
        rows = list(zip(*map(scanner.scan, batches.strings(batch)))) or [()] * len(COLUMNS)
        return {"doc_id": batch.column("doc_id"), **{c: list(v) for c, v in zip(COLUMNS, rows)}}

    return work


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Findings of every document in one pass; no shuffle."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_texts(
        batches.id_text(docs), _scanning,
        f"doc_id {ids}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double")
