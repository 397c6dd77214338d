"""Personal data: patterns for four kinds, and a trained tagger that adds spans.

The tagger is a character-level bidirectional LSTM with CRF transitions (crf.py), trained in numpy on the driver
from the patterns' spans in a bounded sample: windows of about SAMPLE_DOCS documents, WINDOWS of them at most, half of
them with the spans written as people disguise them (DISGUISES), which no pattern finds. Every whole text is searched
for digits and at-signs; windows of 96 characters that step by 48 are scored wherever one is within 64 characters,
since no kind is without them. The scores of overlapping windows are averaged and one best sequence of tags is sought
over each stretch that they cover, so spans don't break at a window's edge. Spans that meet a pattern's span, or that
lack what their kind can't be without, are dropped.

Defined results: null or empty text has no spans; a text without digits and at-signs isn't scored; rows repeated
each get a row; if the sample holds no span, nothing is added; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm.crf import Tagger

KINDS = ("email", "ip", "card", "phone")
#: The bounds of the training sample.
SAMPLE_DOCS, WINDOWS = 8000, 1600
WIDTH, STEP, REACH = 96, 48, 64
#: Windows scored at a time; the longest stretch decoded as one (longer ones are cut where a character is surely outside).
BATCH, STRETCH = 512, 4096

# What is written in disguise, by kind, and how (two ways).
DISGUISES = {0: [{"@": "(at)", ".": "(dot)"}, {"@": "[at]"}], 1: [{".": "[.]"}, {".": "(.)"}], 2: [{" ": ".", "-": "."}, {" ": "/", "-": "/"}], 3: [{"+": "00"}, {"+": "(00)"}]}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]|\(at\)|\[at\]")
DIGITS = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at-signs: linear on any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---- tagger -------------------------------------------------------------------------------------------------------
def classes(text: str) -> np.ndarray:
    """ASCII characters stand for themselves; 128 is any other, 129 padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, codes, 128).astype(np.int16)


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    """0 outside; 1 + 2 * kind at the first character of a span, one more inside it."""
    tags = np.zeros(length, dtype=np.int8)
    for a, b, kind in reversed(spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    kind = (tags.astype(np.int64) + 1) // 2
    start = np.flatnonzero((kind > 0) & (np.concatenate(([0], kind[:-1])) != kind) | (tags % 2 == 1))
    found = []
    for a in start.tolist():
        b = a + 1
        while b < len(tags) and tags[b] == 2 * kind[a]:
            b += 1
        found.append((a, b, int(kind[a]) - 1))
    return found


def window_starts(text: str) -> list[int]:
    """Grid starts of the windows within reach of a digit or at-sign."""
    found: set[int] = set()
    for m in SIGN.finditer(text):
        low = max(0, m.start() - REACH - WIDTH)
        found.update(range(-(-low // STEP), (m.start() + REACH) // STEP + 1))
    return [k * STEP for k in sorted(found) if k * STEP < len(text)]


def cut(values: np.ndarray, start: int, pad: int) -> np.ndarray:
    part = values[start : start + WIDTH]
    return part if len(part) == WIDTH else np.concatenate((part, np.full(WIDTH - len(part), pad, dtype=part.dtype)))


def plausible(text: str, kind: int) -> bool:
    """What a span of the kind can't be without."""
    digits = len(DIGITS.findall(text))
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+(?:\.|\(dot\))[^\s@]+", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= digits <= 19 and luhn("".join(DIGITS.findall(text))) and not re.search(r"[^\W\d_]", text)
    return 9 <= digits <= 15 and not re.search(r"[^\W\d_]", text)


def disguised(text: str, spans: list[Span], how: int) -> tuple[str, list[Span]]:
    """The text with its spans (which don't overlap) rewritten, and where they then are."""
    parts, found, at, length = [], [], 0, 0
    for a, b, kind in spans:
        if a < at:
            continue
        new = text[a:b]
        for old, put in DISGUISES[kind][how].items():
            new = new.replace(old, put)
        parts += [text[at:a], new]
        length += a - at
        found.append((length, length + len(new), kind))
        length, at = length + len(new), b
    return "".join([*parts, text[at:]]), found


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(C.ids_of(batch).tolist(), C.strings_of(batch)):
            spans = base_spans(text)
            for text, spans in [(text, spans)] + [disguised(text, spans, doc_id & 1)] * bool(spans):
                values, tags = classes(text), tags_of(spans, len(text))
                rows += [(doc_id, a, cut(values, a, 129).astype("<i2").tobytes(), cut(tags, a, 0).tobytes()) for a in window_starts(text)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "at", "x", "y"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, windows: int = WINDOWS, rounds: int = 10) -> Tagger | None:
    """Fit on the windows of about sample documents chosen by a hash of their id; windows of them at most."""
    n = docs.count()
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1)))
    found = chosen.mapInArrow(_examples, "doc_id long, at long, x binary, y binary")
    rows = found.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "x").limit(windows).select("x", "y").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype="<i2").reshape(-1, WIDTH)
    y = np.frombuffer(b"".join(bytes(r["y"]) for r in rows), dtype=np.int8).reshape(-1, WIDTH)
    return Tagger(130, 1 + 2 * len(KINDS)).train(x, y.astype(np.int64), rounds=rounds) if y.any() else None


def stretches(starts: list[int], length: int) -> list[tuple[int, int]]:
    """First and last character (exclusive) of what overlapping windows cover."""
    found: list[list[int]] = []
    for a in starts:
        if found and a < found[-1][1]:
            found[-1][1] = min(a + WIDTH, length)
        else:
            found.append([a, min(a + WIDTH, length)])
    return [(a, b) for a, b in found]


def shorter(score: np.ndarray, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a stretch that begins at a place: STRETCH characters at most, cut where a character most surely lies
    outside of any span."""
    while len(score) > STRETCH:
        low = STRETCH - STRETCH // 8
        k = low + int((score[low:STRETCH, 0] - score[low:STRETCH, 1:].max(axis=1)).argmax())
        yield at, score[:k]
        score, at = score[k:], at + k
    yield at, score


def model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of the tagger in several texts: window scores averaged, then decoded by stretch."""
    found: list[list[Span]] = [[] for _ in texts]
    jobs: list[tuple[int, int, np.ndarray, np.ndarray, list[int]]] = []  # text, first character, sums, counts, windows
    for i, text in enumerate(texts):
        starts = window_starts(text)
        for a, b in stretches(starts, len(text)):
            jobs.append((i, a, np.zeros((b - a, model.tags), np.float32), np.zeros((b - a, 1), np.float32), [s for s in starts[bisect_left(starts, a) : bisect_left(starts, b)]]))
    values = {i: classes(texts[i]) for i in {j[0] for j in jobs}}
    windows = [(job, s) for job in jobs for s in job[4]]
    for at in range(0, len(windows), BATCH):
        part = windows[at : at + BATCH]
        for ((_, first, sums, counts, _), s), row in zip(part, model.scores(np.stack([cut(values[job[0]], s, 129) for job, s in part]))):
            sums[s - first : s - first + WIDTH] += row[: len(sums) - (s - first)]
            counts[s - first : s - first + WIDTH] += 1
    pieces = sorted(((i, at, piece) for i, a, sums, counts, _ in jobs for at, piece in shorter(sums / counts, a)), key=lambda p: len(p[2]))
    for at in range(0, len(pieces), BATCH):
        part = pieces[at : at + BATCH]
        for (i, first, _), tags in zip(part, model.decode([score for *_, score in part])):
            found[i] += [(first + a, first + b, kind) for a, b, kind in spans_of(tags)]
    return [sorted(f) for f in found]


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many characters, which bounds the scores held."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _find(sent):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tagger | None = sent.value
        for batch in batches:
            texts = [t if SIGN.search(t) else "" for t in C.strings_of(batch)]
            base = [base_spans(t) if t else [] for t in texts]
            added = [s for a, b in groups(texts) for s in model_spans(model, texts[a:b])] if model else [[]] * len(texts)
            rows = []
            for text, own, more in zip(texts, base, added):
                more = [s for s in more if plausible(text[s[0] : s[1]], s[2]) and not any(a < s[1] and s[0] < b for a, b, _ in own)]
                rows.append((*(sum(s[2] == k for s in own) for k in range(4)), _show(own), _show(sorted(own + more, key=lambda s: (s[0], s[2])))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run


def find_pii(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (patterns), base and spans (kind:start:end, in
    code points, of the patterns and of both)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_find(sent), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
