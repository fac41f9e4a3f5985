"""Licence scans: one Aho-Corasick pass finds phrases and identifier tags; expressions are evaluated.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. All
phrases are looked up in one automaton over the words joined by single spaces. Where an identifier
tag stands and a colon follows, its expression (identifiers with and, or, with and brackets) is read from the
text by a shunting-yard parser; the automaton's word is mapped back to its place in the text.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count as base, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases of common licences, with their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "creative commons zero": "cc0",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software": "public-domain",
}
TAG = "spdx license identifier"

#: How freely a text under the label may be reused; labels not named here count 0.5.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "apache-2": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "bsl": 1.0, "artistic": 0.8, "eupl": 0.5, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0,
}

_DELIMITERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: What must stand between a tag and its expression.
_COLON = re.compile(r"\s*:[^\S\r\n]*", re.ASCII)
#: Brackets, identifiers and operators, line ends, and what else is not blank.
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*|[\r\n]|[^\s]", re.ASCII)
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """An identifier's label: the family of the licence, with its version left out but for apache-2."""
    for start, label in (("apache-2", "apache-2"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("epl", "epl"), ("bsd", "bsd"), ("mit", "mit"), ("isc", "isc")):
        if identifier == start or identifier.startswith((f"{start}-", f"{start}.", f"{start}+")):
            return label
    return identifier


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels of an expression and its freedom: or takes the freest side, and the strictest; with
    an exception adds a little to what it stands on. None where the expression is not well formed.

    An expression ends where prose follows, and at a line end or another character outside brackets;
    inside brackets these are passed over (comment marks before a further line).
    """
    output, waiting, operand, depth = [], [], False, 0
    for token in (m[0] for m in _TOKEN.finditer(expression.lower())):
        if token in _BINDS:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting or not operand:
                return None
            waiting.pop()
            depth -= 1
        elif not ("a" <= token[0] <= "z" or "0" <= token[0] <= "9"):
            if not depth:
                break
        elif operand:
            break  # prose follows the expression
        else:
            output.append((token,))
            operand = True
    while waiting:
        if (top := waiting.pop()) != "(":
            output.append(top)
    stack: list[tuple[set[str], float]] = []
    for item in output:
        if isinstance(item, tuple):
            label = label_of(item[0])
            stack.append(({label}, FREEDOM.get(label, 0.5)))
            continue
        if len(stack) < 2:
            return None
        (right, b), (left, a) = stack.pop(), stack.pop()
        if item == "with":
            stack.append((left, min(1.0, a + 0.1)))
        else:  # the smaller set goes into the larger one
            both, other = (left, right) if len(left) >= len(right) else (right, left)
            both |= other
            stack.append((both, max(a, b) if item == "or" else min(a, b)))
    return stack[0] if len(stack) == 1 else None


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def expressions(text: str, tags: list[int]) -> Iterator[str]:
    """What follows each identifier tag (told by its first word) and its colon, up to the next one: together no more
    than the text."""
    words, last = [m.span() for m in _WORD.finditer(text)], TAG.count(" ")
    follows = [(words[i][0], m.end()) for i in tags if (m := _COLON.match(text, words[i + last][1]))]
    for (_, start), (end, _) in zip(follows, [*follows[1:], (len(text), 0)]):
        yield text[start:end]


def scan(text: str, machine) -> tuple:
    words = text.encode("utf-8", "surrogatepass").translate(_DELIMITERS).decode("utf-8", "surrogatepass").split(" ")
    words = [w for w in words if w]
    base, at, tags, found, freedom = set(), [], [], set(), []
    for end, phrase in machine.iter(f" {' '.join(words)} "):
        if phrase in BASE:
            base.add(BASE[phrase])
            at.append(end - len(phrase))  # where its first word starts
        elif phrase in NOTICES:
            found.add(NOTICES[phrase])
        else:
            tags.append(end - len(phrase))
    places = []
    if at or tags:
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=1))
        places, tags = ([bisect.bisect_left(starts, x) for x in xs] for xs in (at, tags))
    freedom = [FREEDOM.get(x, 0.5) for x in base | found]
    for expression in expressions(text, tags) if tags else ():
        if value := evaluate(expression):
            found |= value[0]
            freedom.append(value[1])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), min(freedom, default=0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for every document: words, base places and labels, all labels, freedom of reuse.

    score is the least freedom of the text's licences, 0 without any: those of phrases by their labels,
    those of identifier tags by their whole expression. Null texts are empty; a null doc_id stays null;
    repeated rows are scanned each; extra columns are ignored. Texts of any length are read whole, each
    word and each expression once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan(t or "", machine) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, SCHEMA)
