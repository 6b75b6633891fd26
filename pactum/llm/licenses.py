"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

One automaton holds the words of all notice phrases; it runs once over the
words of a text, lower-cased and joined by single spaces, so that overlapping
and nested phrases are all found, whatever stands between their words. A second
one holds the identifier tags (``SPDX-License-Identifier:`` and the like) and
runs over the lower-cased text itself. What follows a tag on its line is read
as a licence expression: identifiers, ``AND``, ``OR``, ``WITH`` and brackets,
in either case. The parser keeps a stack of operators (``WITH`` binds
closest, then ``AND``, then ``OR``) and yields the expression's terms in
postfix order, which are evaluated to how much they restrict: ``OR`` lets one
choose the freer side, ``AND`` binds to both, ``WITH`` grants an exception.
Reading ends at the first token that cannot continue an expression, so prose
after a tag is no licence; an incomplete expression (``MIT OR``) counts as its
longest complete beginning, and a bracket that is never closed is closed there.

``score`` is how much the text's licences restrict its use, from 0 (no
licence found, or public domain) to 1 (all rights reserved): the largest
over phrases and expressions.

Defined results: a null text is the empty one, with no words and null
``first_word`` and ``last_word``; a tag or phrase counts wherever it stands, in
texts of any length; repeated rows and ids have a row each; null ids stay null;
further columns are ignored; an empty table gives an empty result. Labels
within a text are distinct and sorted by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import named, text_slices, texts_of

#: The base phrases and their labels: fixed values of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases, in the words that the scan sees.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "apache license": "apache", "apache software license": "apache",
    "mit license": "mit", "isc license": "isc", "bsd license": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "cc0": "cc0", "creative commons zero": "cc0", "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain",
    "gnu free documentation license": "gfdl", "open database license": "odbl", "proprietary and confidential": "proprietary", "do not distribute": "proprietary",
}
#: Tags that a licence expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:", "licenses:", "@license ", "@licence ")

#: Families of identifiers, the longest beginning that fits decides: label, and how much they restrict.
FAMILIES = {
    "0bsd": ("bsd", 0.1), "afl": ("afl", 0.2), "agpl": ("agpl", 0.8), "apache": ("apache", 0.2), "artistic": ("artistic", 0.3), "bsd": ("bsd", 0.2), "bsl": ("bsl", 0.2),
    "cc-by": ("cc-by", 0.3), "cc-by-nc": ("cc-by-nc", 0.8), "cc-by-nc-nd": ("cc-by-nc-nd", 0.9), "cc-by-nc-sa": ("cc-by-nc-sa", 0.8), "cc-by-nd": ("cc-by-nd", 0.8), "cc-by-sa": ("cc-by-sa", 0.5),
    "cc0": ("cc0", 0.0), "cddl": ("cddl", 0.4), "epl": ("epl", 0.4), "eupl": ("eupl", 0.5), "gfdl": ("gfdl", 0.6), "gpl": ("gpl", 0.6), "isc": ("isc", 0.2), "lgpl": ("lgpl", 0.4),
    "mit": ("mit", 0.2), "mpl": ("mpl", 0.4), "ms-pl": ("ms-pl", 0.3), "odbl": ("odbl", 0.5), "ofl": ("ofl", 0.3), "proprietary": ("proprietary", 1.0), "psf": ("psf", 0.2), "python": ("psf", 0.2),
    "public-domain": ("public-domain", 0.0), "reserved": ("reserved", 1.0), "unlicense": ("unlicense", 0.0), "wtfpl": ("wtfpl", 0.0), "zlib": ("zlib", 0.2),
}
OTHER = 0.7  # a licence of no known family, such as LicenseRef-x
EXCEPTION = 0.2  # what WITH takes off, at most down to 0.3

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TOKEN = re.compile(r"[ \t]*+(?:([()])|([a-z0-9][a-z0-9.+-]*+))")
_RANK = {"or": 1, "and": 2, "with": 3}


@dataclass
class Scan:
    """What one text holds."""

    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    score: float = 0.0


def family(identifier: str) -> tuple[str, float] | None:
    """Label and restriction of a licence identifier; None where its family is not known."""
    name = identifier[:64].rstrip("+")  # no family has so long a name
    while name:
        if name in FAMILIES:
            return FAMILIES[name]
        cut = max(name.rfind("-"), name.rfind("."))
        name = name[:cut] if cut > 0 else ""
    return None


def postfix(text: str, at: int) -> list[str]:
    """The longest complete expression from ``at``, as its terms in postfix order; empty if there is none.

    Operators wait on a stack until one that binds less, or a closing bracket,
    follows. Line breaks are no white space here, so an expression ends with its line.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an identifier or an opening bracket must come next
    exception = single = False  # whether the name of an exception must come; whether a single licence was the last
    depth = 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        bracket, word = m.groups()
        if operand:
            if bracket == "(" and not exception:
                stack.append("(")
                depth += 1
                continue
            if word is None or word in _RANK:
                break
            name = word.rstrip(".")
            if not exception and family(name) is None and not name.startswith("licenseref-"):
                break
            out.append(name)
            operand, exception, single = False, False, not exception
            if name != word:
                break  # the full stop that ends a sentence
        elif bracket == ")" and depth:
            while (op := stack.pop()) != "(":
                out.append(op)
            depth -= 1
            single = False
        elif word in _RANK and (single or word != "with"):  # only a single licence can have an exception, and only one
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand, exception = True, word == "with"
        else:
            break
    if operand:  # the last operator, and brackets after it, have nothing to their right
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [op for op in reversed(stack) if op != "("]


def evaluate(terms: list[str]) -> tuple[set[str], float]:
    """Labels of an expression in postfix order, and how much it restricts: OR the less, AND the more of its sides."""
    labels: set[str] = set()
    stack: list[float] = []
    named_exception = {k - 1 for k, t in enumerate(terms) if t == "with"}  # WITH follows its exception at once
    for k, term in enumerate(terms):
        if k in named_exception:
            labels.add("exception")
        elif term == "with":
            stack[-1] = min(stack[-1], max(0.3, stack[-1] - EXCEPTION))
        elif term in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if term == "or" else max(a, b))
        else:
            label, much = family(term) or ("other", OTHER)
            labels.add(label)
            stack.append(much)
    return labels, stack[-1]


class Scanner:
    """Both automata; built once per task."""

    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            # spaces around, so that a phrase begins and ends with whole words
            self.phrases.add_word(f" {phrase} ", (len(phrase), label, phrase in BASE))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> Scan:
        out = Scan()
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_TO_WORDS).split(b" ")  # other white space has become a space too
        words = [w for w in words if w]
        out.n_words = len(words)
        if not words:
            return out
        joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        at = word = 0
        for end, (length, label, base) in self.phrases.iter(joined):
            out.labels.add(label)
            out.score = max(out.score, FAMILIES[label][1])
            if base:
                start = end - length  # of the phrase's first character; phrases may begin before the last one found
                word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
                at = start
                out.n_base += 1
                out.base_labels.add(label)
                out.first_word = word - 1 if out.first_word is None else min(out.first_word, word - 1)
                out.last_word = word - 1 if out.last_word is None else max(out.last_word, word - 1)
        self.expressions(raw.lower().decode("utf-8", "replace"), out)  # bytes.lower touches A-Z only
        return out

    def expressions(self, lowered: str, out: Scan) -> None:
        for end, tag in self.tags.iter(lowered):
            before = end - len(tag)
            if before >= 0 and (lowered[before].isalnum() or lowered[before] == "-"):
                continue  # the end of another name, such as sub-license:
            terms = postfix(lowered, end + 1)
            if terms:
                labels, much = evaluate(terms)
                out.labels |= labels
                out.score = max(out.score, much)
                out.expressions.append(" ".join(terms))


def scan_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: words, base phrases, labels, expressions (in postfix order, joined by ``; ``) and score."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("expressions", T.StringType()),
    ])

    def run(batches):
        scanner = Scanner()
        joined = lambda labels: ",".join(sorted(labels))
        for batch in batches:
            for start, end in text_slices(batch):
                found = [scanner.scan(t) for t in texts_of(batch, start, end)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start),
                    *[pa.array([getattr(s, c) for s in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
                    *[pa.array([joined(getattr(s, c)) for s in found], pa.string()) for c in ("base_labels", "labels")],
                    pa.array([s.score for s in found], pa.float64()), pa.array(["; ".join(s.expressions) for s in found], pa.string()),
                ], names=schema.names)

    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(run, schema)
