"""Licence scans by ordered signature rules.

A text becomes lower-cased words joined by single blanks. One pass of an
Aho-Corasick automaton over the rules' keywords finds which rules can match at
all (usually none); only those run, each over the whole text. What they find
overlaps, so of two detections where one's interval contains the other's, the
one whose rule comes first in priority stays, the longer one at equal
priority; detections that merely overlap both stay. Places of the base phrases
always stay and suppress nothing.

What stays after suppression, of rules that name a licence, gives the labels;
the score joins the evidence: 1 minus the product of what each kept label
leaves in doubt, a label counting once with its best rule.

Defined results: null, empty and wordless texts have no words, no places, no
labels ('') and score 0; repeated rows and ids keep their rows, null ids too;
an empty table gives no rows; other columns are ignored whatever their names.
Texts are read whole; the work is linear in them but for the sorting of what
is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .decontaminate import WORD, words
from .license_rules import WORTH, rules

SPAN = pa.struct([("rule", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first_word", pa.int64())])


@cache
def compiled() -> tuple[list[tuple[str, str, re.Pattern]], ahocorasick.Automaton]:
    """(kind, label, pattern) in order of priority, and the automaton from keywords to the numbers of their rules."""
    found, by_keyword = [], {}
    for i, (kind, label, keyword, pattern) in enumerate(rules()):
        found.append((kind, label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
        by_keyword.setdefault(keyword, []).append(i)
    auto = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        auto.add_word(keyword, tuple(numbers))
    auto.make_automaton()
    return found, auto


def detect(text: str) -> list[tuple[int, int, int]]:
    """(rule, start, stop) of every match of every rule whose keyword occurs, in order of priority."""
    ordered, auto = compiled()
    numbers = {x for _, x in auto.iter(text)}
    return [(i, *m.span()) for i in sorted({i for x in numbers for i in x}) for m in ordered[i][2].finditer(text)]


def settle(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What stays: no interval of the result contains another, so both their starts and their ends ascend."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []  # (start, stop, rule)
    for rule, start, stop in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        at = bisect_left(starts, start + 1)
        if at and kept[at - 1][1] >= stop:
            continue  # contained in one of a higher priority
        first = bisect_left(starts, start)
        if first < len(kept) and kept[first][1] <= stop:
            continue  # contains one of a higher priority
        insort(starts, start)
        kept.insert(at, (start, stop, rule))
    return [(rule, start, stop) for start, stop, rule in kept]


def scan(own: list[bytes]) -> tuple[list[tuple[int, str, int, int]], list[int], set[str], float]:
    """(rule, label, first and end word) of what stays, first words of base places in order, labels and score."""
    text = b" ".join(own).decode("utf-8", "replace")
    found = detect(text)
    if not found:
        return [], [], set(), 0.0
    ordered = compiled()[0]
    base = [x for x in found if ordered[x[0]][0] == "base"]
    stays = settle([x for x in found if ordered[x[0]][0] != "base"])
    spans, worth, at, seen = [], {}, 0, 0
    for rule, start, stop in sorted(stays + base, key=lambda x: (x[1], x[2], x[0])):
        kind, label, _ = ordered[rule]
        seen += text.count(" ", at, start)
        at = start
        spans.append((rule, label, seen, seen + text.count(" ", start, stop) + 1))
        worth[label] = max(worth.get(label, 0.0), WORTH[kind])
    doubt = 1.0
    for label in sorted(worth):
        doubt *= 1 - worth[label]
    places = [first for rule, _, first, _ in spans if ordered[rule][0] == "base"]
    return spans, places, {label for rule, label, *_ in spans if ordered[rule][0] != "hint"}, 1 - doubt


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id_col``, n_words, spans, base_places, base_labels, labels (both sorted) and score.

    A span has the number of its rule, its label, its offsets in code points of the text as it was, and its first word;
    base_places are the first words of the base phrases.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = compiled()[0]
        for batch in batches:
            for part in slices(batch, "_text"):
                n, spans, places, base, labels, scores = [], [], [], [], [], []
                for text in utf8(part, "_text"):
                    own = words(text)
                    found, at, names, score = scan(own)
                    n.append(len(own))
                    spans.append(_original(text, found))
                    places.append(at)
                    base.append(sorted({label for rule, label, *_ in found if ordered[rule][0] == "base"}))
                    labels.append(sorted(names))
                    scores.append(score)
                columns = {
                    "n_words": pa.array(n, pa.int64()),
                    "spans": pa.array(spans, pa.list_(SPAN)),
                    "base_places": pa.array(places, longs),
                    "base_labels": pa.array(base, strings),
                    "labels": pa.array(labels, strings),
                    "score": pa.array(scores, pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns.values()], ["_id", *columns])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    span = "array<struct<rule:int,label:string,start:long,stop:long,first_word:long>>"
    out = out.mapInArrow(run, f"_id {kind}, n_words long, spans {span}, base_places array<long>, base_labels array<string>, labels array<string>, score double")
    return out.withColumnRenamed("_id", id_col)


def _original(text: bytes, found: list[tuple[int, str, int, int]]) -> list[dict]:
    """Ranges of words as offsets of code points in the text as it was."""
    if not found:
        return []
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "surrogateescape"))]
    return [{"rule": rule, "label": label, "start": at[a][0], "stop": at[b - 1][1], "first_word": a} for rule, label, a, b in found]
