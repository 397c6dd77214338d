"""License scan by ordered signature rules.

Texts are lower-cased (A-Z) and reduced to words; rules (license_rules.py) are regular expressions, written by hand,
over the words joined by spaces. A rule runs only where its keyword occurs, which stands in whatever the rule can
match. Detections are resolved by interval: among the places found, a detection inside (or equal to) another of the
same or higher priority is suppressed; longer ones win, then rule order.

Defined results: null text or text without words gives zero words, no labels and score 0; a place is counted for each
base phrase; rows repeated each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm.license_rules import MACROS, RULES

# Phrases whose every place is counted, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> list[Rule]:
    """The rules in order of priority, then as written. A pattern begins with the space before its first word."""
    found, label = [], ""
    for line in filter(str.strip, RULES.splitlines()):
        if not line.startswith(" "):
            label = line.strip()
            continue
        about, pattern = line.split(" | ")
        priority, sure, keyword = about.split(maxsplit=2)
        for name, text in MACROS.items():
            pattern = pattern.replace("{%s}" % name, text)
        found.append(Rule(label, keyword.encode(), re.compile(f" {pattern.strip()}(?= )".encode()), int(priority), float(sure)))
    return sorted(found, key=lambda r: r.priority)


@cache
def by_keyword() -> list[tuple[bytes, list[tuple[int, Rule]]]]:
    found: dict[bytes, list] = {}
    for i, r in enumerate(rules()):
        found.setdefault(r.keyword, []).append((i, r))
    return list(found.items())


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (start, end, priority, rule) those that lie in no other of the same or higher priority. For each
    priority one sweep from the left, outer ones first, with the furthest end so far."""
    left = []
    for priority in sorted({d[2] for d in found}):
        furthest = -1
        for d in sorted((d for d in found if d[2] <= priority), key=lambda d: (d[0], -d[1], d[2], d[3])):
            if d[2] == priority and d[1] > furthest:
                left.append(d)
            furthest = max(furthest, d[1])
    return left


def detections(joined: bytes) -> list[tuple[int, int, Rule]]:
    """What is left (start, end, rule; in bytes) after suppression."""
    padded = b" " + joined + b" "
    found = [(m.start(), m.end() - 1, r.priority, i) for word, own in by_keyword() if word in joined for i, r in own for m in r.pattern.finditer(padded)]
    return [(a, b, rules()[i]) for a, b, _, i in suppressed(found)] if found else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.string())])
    for batch in batches:
        rows = []
        for text in C.bytes_of(batch):
            words = C.words_of(text)
            joined = b" ".join(words)
            places, kept = [], detections(joined)
            for phrase, label in BASE:
                needle, at = phrase.encode(), -1
                while (at := joined.find(needle, at + 1)) >= 0:
                    end = at + len(needle)
                    if (at == 0 or joined[at - 1] == 32) and (end == len(joined) or joined[end] == 32):
                        places.append((at, label))
            begins = list(accumulate((len(w) + 1 for w in words), initial=0)) if places or kept else []  # byte each word begins at
            starts, base = [bisect_left(begins, at) for at, _ in places], {label for _, label in places}
            score = max([0.95 * bool(base), *(r.confidence for _, _, r in kept)])
            spans = ",".join(f"{bisect_left(begins, a)}:{bisect_left(begins, b)}:{r.label}" for a, b, r in sorted(kept, key=lambda d: d[:2]))
            rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})), score, spans))
        columns = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (first word:end word:label of what was left, in order)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
