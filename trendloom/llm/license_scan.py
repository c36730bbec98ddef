"""Operator 7: licence scan of whole texts.

One Aho-Corasick automaton finds identifier tags and notice phrases in the text's words (lower case, split at anything
but ASCII digits, letters and non-ASCII characters), so a phrase matches where its words stand consecutively, whatever
stands between them. After a tag (`SPDX-License-Identifier:`) the licence expression is read from the text and parsed
with the shunting-yard method (with over and over or, brackets). Identifiers of the expression that `KNOWN` lists are
labels, and `allowed` says whether the expressions of the text can all be met with licences of `PERMISSIVE` alone.

Defined cases: null and empty texts have no words, no labels (empty strings), score 0 and no verdict (`allowed` null);
repeated rows are scanned each for itself; an expression is read up to the first thing that does not fit, and what
lacks its right side there (operators, opening brackets) is left out; identifiers that are not known are operands of
the expression but no labels; very long texts take time in proportion to their length; an empty table gives no rows;
extra columns are ignored. The work is row by row, so nothing depends on how sources or copies are spread.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method itself, with the labels they give.
NOTICES = {
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "eclipse public license": "epl",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "european union public licence": "eupl",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: SPDX identifiers in lower case. Those that ask for no more than a notice, and the others.
PERMISSIVE = frozenset("0bsd apache-1.1 apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit mit-0 ncsa postgresql python-2.0 unlicense wtfpl x11 zlib".split())
KNOWN = PERMISSIVE | frozenset(
    "afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later artistic-2.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cpl-1.0 "
    "epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0+ gpl-3.0-only gpl-3.0-or-later "
    "lgpl-2.0 lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 ms-pl ms-rl odbl-1.0 ofl-1.1 osl-3.0 proprietary sspl-1.0".split()
)
TAG = "spdx license identifier"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TAG_TEXT = re.compile(r"spdx-license-identifier:")
TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)")
RANK = {"or": 1, "and": 2, "with": 3}


def tokens(text: str, at: int = 0) -> Iterator[str]:
    """Tokens of an expression (lower case) from a place on, up to the first that is none."""
    while m := TOKEN.match(text, at):
        yield m[1]
        at = m.end()


def postfix(read: Iterator[str]) -> list[str]:
    """Shunting-yard: an expression in postfix order; reading stops where it no longer parses."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last thing read was an operand
    for t in read:
        if t in RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            stack.append(t)
        elif t == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(t)
            operand = True
    # What waits for a right side that never came goes: brackets, then the operator before them.
    while stack and not operand:
        operand = stack.pop() != "("
    return out + [s for s in reversed(stack) if s != "("]


def parse_expression(text: str) -> list[str]:
    return postfix(tokens(text.lower()))


def identifiers(postfix: list[str]) -> set[str]:
    """Licences of an expression; what follows `with` is an exception to one, not a licence."""
    stack: list[set[str]] = []
    for t in postfix:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a | b)
        else:
            stack.append({t})
    return set().union(*stack) if stack else set()


def allows(postfix: list[str], allowed: frozenset[str] | set[str]) -> bool:
    """Whether the licences allowed satisfy the expression: all of `and`, one of `or`, the licence before `with`."""
    stack: list[bool] = []
    for t in postfix:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            stack.append({"or": a or b, "and": a and b, "with": a}[t])
        else:
            stack.append(t in allowed)
    return bool(stack) and all(stack)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, found) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, allowed, expressions."""
    low = (text or "").encode().lower().decode()  # of bytes: A-Z only
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    base, labels, ends, expressions = set(), set(), [], []
    weight, tagged = 0.0, False
    for end, phrase in found.iter(line):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            ends.append((end, phrase))
            base.add(BASE[phrase])
            weight += 1.0
        else:
            labels.add(NOTICES[phrase])
            weight += 0.7
    first = last = None
    if ends:
        begins = list(accumulate((len(w) + 1 for w in words), initial=1))  # where each word begins in the line
        places = [bisect_left(begins, end - len(phrase)) for end, phrase in ends]
        first, last = min(places), max(places)
    if tagged:
        expressions = [e for m in TAG_TEXT.finditer(low) if (e := postfix(tokens(low, m.end())))]
        for e in expressions:
            labels |= identifiers(e) & KNOWN
            weight += 3.0
    allowed = all(allows(e, PERMISSIVE) for e in expressions) if expressions else None
    return len(words), len(ends), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 - 0.5**weight if weight else 0.0, allowed, [" ".join(e) for e in expressions]


#: The columns of a scan, with their types for Spark and Arrow.
COLUMNS = {
    "n_words": ("long", pa.int64()),
    "n_base": ("long", pa.int64()),
    "first_word": ("long", pa.int64()),
    "last_word": ("long", pa.int64()),
    "base_labels": ("string", pa.string()),
    "labels": ("string", pa.string()),
    "score": ("double", pa.float64()),
    "allowed": ("boolean", pa.bool_()),
    "expressions": ("array<string>", pa.list_(pa.string())),
}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row each; `expressions` has the parsed tags in postfix order, `allowed` their verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = [scan(t.as_py(), found) for t in batch.column(1)]
            cells = zip(*rows) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(cells, COLUMNS.values()))], ["doc_id", *COLUMNS])

    kinds = ", ".join(f"{name} {kind}" for name, (kind, _) in COLUMNS.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {kinds}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("expressions", F.array_join("expressions", ";"))
