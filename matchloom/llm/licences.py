"""Operator 8: licence scan of whole texts.

One Aho-Corasick pass over each batch's lower-cased bytes finds words that any licence
phrase or identifier tag needs.  Only texts with such a word are cut into words; a second
automaton then finds the phrases in the words joined by single spaces, so that a phrase
counts wherever its words stand consecutively.  ``SPDX-License-Identifier:`` tags are read
to the next tag or the end of their line, however far, and evaluated by a shunting-yard parser (WITH binds tighter than
AND, AND tighter than OR).

Labels: those of BASE_PHRASES, those of NOTICES, and ``spdx:<identifier>`` for every
identifier of a well-formed expression (``spdx:a-with-b`` for an exception), plus
``permissive`` or ``restricted`` for what its evaluation says.
score: 1 for a well-formed tag, else 1 - 0.5 ** (base places + 2 * notice places).

Defined results: null or empty text has no words, no labels and score 0; malformed
expressions add nothing; repeated rows and extra columns do not matter; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import LOWER, arrow_batches, utf8_buffer

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases of the method, in words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "notice-mit",
    "redistribution and use in source and binary forms": "notice-bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "notice-cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Identifiers (lower case) that an evaluation takes as permissive.
PERMISSIVE = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc zlib unlicense cc0-1.0 cc-by-4.0 cc-by-3.0 0bsd bsl-1.0".split())
#: A word (or run of bytes) that each phrase or tag needs.
ANCHORS = ("license", "spdx-license-identifier", "cc", "cc0", "permission", "redistribution", "creative", "unencumbered", "reserved")

IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TAG = re.compile(rb"spdx-license-identifier:")
LINE_END = re.compile(rb"[\r\n]")
TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9.+:-]+)", re.ASCII)
RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> tuple[list[str], bool] | None:
    """Identifiers of a licence expression and whether it can be met permissively; None if malformed.

    Reads the longest well-formed start of the line, so that comment ends after it do not matter.
    """
    tokens, at, depth, operand_next, good = [], 0, 0, True, 0
    while m := TOKEN.match(text, at):
        token, at = m[1], m.end()
        # What may begin an operand comes where one is due, all else where one has ended.
        if (token not in RANK and token != ")") != operand_next or (token == ")" and not depth):
            break
        tokens.append(token)
        depth += (token == "(") - (token == ")")
        operand_next = token in RANK or token == "("
        if not operand_next and not depth:
            good = len(tokens)
    if not good:
        return None
    output: list[tuple[list[str], bool]] = []
    operators: list[str] = []

    def reduce() -> None:
        op = operators.pop()
        (b, free_b), (a, free_a) = output.pop(), output.pop()
        if op == "with":
            a[-1] = f"{a[-1]}-with-{b[0]}"
            output.append((a + b[1:], free_a))
        else:
            a.extend(b)
            output.append((a, free_a and free_b if op == "and" else free_a or free_b))

    for token in tokens[:good]:
        if token in RANK:
            while operators and operators[-1] != "(" and RANK[operators[-1]] >= RANK[token]:
                reduce()
            operators.append(token)
        elif token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                reduce()
            operators.pop()
        else:
            output.append(([token], token in PERMISSIVE))
    while operators:
        reduce()
    return output[0]


@cache
def automata() -> tuple[object, object]:
    import ahocorasick

    anchors, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word in ANCHORS:
        anchors.add_word(word, word)
    for kind, table in enumerate((BASE_PHRASES, NOTICES)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    anchors.make_automaton()
    phrases.make_automaton()
    return anchors, phrases


def scan(low: bytes) -> tuple[int, int | None, int | None, str, str, float]:
    """n_base, first_word, last_word, base_labels, labels, score of one lower-cased text."""
    words = [m.group() for m in WORD.finditer(low)]
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]) if words else np.zeros(1, np.int64)
    # The joined words begin with a space: word k starts at starts[k] + 1 there.
    joined = f" {b' '.join(words).decode('latin-1')} "
    places, base, more, notices = [], set(), set(), 0
    for end, (kind, label, length) in automata()[1].iter(joined):
        if kind == 0:
            places.append(int(np.searchsorted(starts, end - length)))
            base.add(label)
        else:
            more.add(label)
            notices += 1
    tagged = False
    tags = list(TAG.finditer(low))
    for m, following in zip(tags, [*tags, None][1:], strict=True):
        stop = LINE_END.search(low, m.end(), following.start() if following else len(low))
        stop = stop.start() if stop else following.start() if following else len(low)
        if (got := parse_expression(low[m.end() : stop].decode("utf-8", "replace"))) is not None:
            tagged = True
            more.update(f"spdx:{x}" for x in got[0])
            more.add("permissive" if got[1] else "restricted")
    score = 1.0 if tagged else 1 - 0.5 ** (len(places) + 2 * notices)
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the columns of RESULT."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automata()[0]
        for batch in batches:
            data, offsets = utf8_buffer(batch.column(1))
            low = LOWER[data]
            inside = IS_WORD[low]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            begins[heads] = inside[heads]
            total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
            n_words = total[offsets[1:]] - total[offsets[:-1]]
            raw = low.tobytes()
            hits = {int(x) for x in np.searchsorted(offsets, [e for e, w in anchors.iter(raw.decode("latin-1")) if _whole(inside, begins, e, len(w))], "right") - 1}
            found = [scan(raw[offsets[k] : offsets[k + 1]]) if k in hits else (0, None, None, "", "", 0.0) for k in range(len(n_words))]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.record_batch([batch.column(0), pa.array(n_words), *(pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[2:], strict=True))], schema=RESULT)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _whole(inside: np.ndarray, begins: np.ndarray, end: int, length: int) -> bool:
    """Whether a short hit is a word of its own; begins knows where texts adjoin in the buffer."""
    after = end + 1
    return length > 4 or bool(begins[after - length] and not (after < len(inside) and inside[after] and not begins[after]))
