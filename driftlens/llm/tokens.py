"""Exact tokenization of whole texts by their distinct pieces.

A pre-tokenizer never joins what stands on both sides of a space between two visible characters, nor what stands
before and after a lone line feed between them. So texts are cut there, the distinct pieces of many texts are found
in one pass (Arrow's dictionary encoding), the tokenizers library encodes each of them that isn't known yet, and the
ids of the texts are gathered from them. Of a new piece that is a plain word with a tail of signs, as "word," is,
word and tail are separate to a pre-tokenizer: the library's model encodes the word alone. Texts with other white
space are cut at spaces between plain characters only; texts that name a special token aren't cut.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words (and other pieces) that a worker remembers, some 80 MB; it forgets them all when there are more. Longer ones aren't remembered.
CACHE_WORDS, CACHE_CHARS = 300_000, 60
CUT = "\x01"

# Letters whose lower case and normal form are theirs alone, and the signs that may follow them.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "!-&(-/:-@\\[-`{-~"
PLAIN = f"^(?P<word> ?[{LETTERS}]+)(?P<tail>[{SIGNS}]*)$"
BETWEEN = re.compile("(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")

_encoders: dict[str, Encoder] = {}


def strings(values: pa.Array) -> list[str]:
    """The strings of an array (none of which holds CUT), by one conversion instead of one each."""
    if not len(values):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string()))
    return pc.binary_join(one, CUT)[0].as_py().split(CUT)


def gather(table: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a table (by place and size) one after another, and where each ends."""
    ends = np.cumsum(size)
    at = np.repeat((place - ends + size).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return table[at], ends


def byte_letters() -> dict[int, int]:
    """The character that a byte-level vocabulary has for each byte: itself if visible, else one from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(visible)))}


class Encoder:
    """ids() gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, words: int | None = None):
        self.words = words  # remembered at most; None: CACHE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.forget()
        probes = [f"{space}{word}" for space in (" ", "") for word in ("the", "Größe", "unfathomableness", "ÉTÉ")]
        self.plain = [self.spell(p) for p in probes] == self.encode(probes)

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # word: place of its ids in found, times 1024, and their number
        self.found = array("I")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        gc.disable()  # many small objects, none of them in cycles
        try:
            return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        finally:
            gc.enable()

    def spell(self, word: str) -> list[int]:
        """Ids of letters, after a space or not, by the library's model; right only where the probes are."""
        if self.lowers:
            word = word.lstrip(" ").lower()
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def learn(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, array]:
        """Place and number of the ids of each piece, and the table that they are in."""
        known, found = self.known, self.found
        packed = [known.get(p, -1) for p in pieces]
        new = [k for k, v in enumerate(packed) if v < 0]
        others = [k for k in new if not plain[k]]
        given = dict(zip(others, self.encode([pieces[k] for k in others])))
        long = []
        for k in new:
            p = pieces[k]
            ids = given[k] if k in given else self.spell(p)
            if len(p) > CACHE_CHARS:
                long.append((k, ids))
                continue
            packed[k] = known[p] = len(found) << 10 | len(ids)
            found.extend(ids)
        packed = np.array(packed, dtype=np.int64)
        place, size = packed >> 10, packed & 1023
        if long:
            found = found[:]
            for k, ids in long:
                place[k], size[k] = len(found), len(ids)
                found.extend(ids)
        return place, size, found

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and where each ends."""
        n, held = len(pieces), np.zeros(len(pieces), dtype=bool)
        words, tails = pieces, pa.nulls(n, pieces.type).fill_null("")
        if self.plain:
            parts = pc.extract_regex(pieces, PLAIN)
            held = parts.is_valid().to_numpy(zero_copy_only=False)
            word = parts.field("word")
            word = pc.if_else(held, pc.utf8_lower(pc.utf8_ltrim(word, " ")) if self.lowers else word, pieces)
            words, tails = word.cast(pieces.type), pc.if_else(held, parts.field("tail"), "").cast(pieces.type)
        words, tails = words.dictionary_encode(), tails.dictionary_encode()
        codes = words.indices.to_numpy()
        plain = np.zeros(len(words.dictionary), dtype=bool)
        plain[codes[held]] = True
        place, size, table = self.learn(strings(words.dictionary), plain)
        signs = self.encode(strings(tails.dictionary))
        at, length = len(table) + np.cumsum([0, *map(len, signs)])[:-1], np.array([len(x) for x in signs], dtype=np.int64)
        both = np.concatenate((np.frombuffer(table, dtype=np.uint32), np.array(sum(signs, []), dtype=np.uint32)))
        after = tails.indices.to_numpy()
        flat, ends = gather(both, np.stack((place[codes], at[after]), axis=1).reshape(-1), np.stack((size[codes], length[after]), axis=1).reshape(-1))
        return flat, ends[1::2]

    def cut(self, text: str) -> str | None:
        """The text with CUT between its pieces; none where it can't be cut."""
        if CUT in text or any(s in text for s in self.special):
            return None
        flat = text.replace("\n", " ")
        if flat.isprintable() and "  " not in flat and flat[0] != " " != flat[-1]:  # spaces and line feeds are single and between words
            return text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}")
        return BETWEEN.sub(CUT, text)

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > (self.words or CACHE_WORDS):
            self.forget()
        marked = [self.cut(t) if t else None for t in texts]
        whole = [i for i, (t, m) in enumerate(zip(texts, marked)) if t and m is None]
        cut = [m for m in marked if m is not None]
        out = [b""] * len(texts)
        for i, ids in zip(whole, self.encode([texts[i] for i in whole])):
            out[i] = array("I", ids).tobytes()
        if not cut:
            return out
        pieces = pc.split_pattern(pa.array([CUT.join(cut)], pa.large_string()), CUT).values.dictionary_encode()
        codes = pieces.indices.to_numpy()
        table, upto = self.distinct(pieces.dictionary)
        first = np.concatenate(([0], upto[:-1]))
        flat, ends = gather(table, first[codes], (upto - first)[codes])
        flat = flat.astype("<u4").tobytes()
        last = np.cumsum([m.count(CUT) + 1 for m in cut])  # pieces up to each text's end
        bounds = np.concatenate(([0], ends[last - 1] * 4)).tolist()
        at = iter(zip(bounds[:-1], bounds[1:]))
        for i, m in enumerate(marked):
            if m is not None:
                a, b = next(at)
                out[i] = flat[a:b]
        return out


def encoder(path: str, words: int | None = None) -> Encoder:
    """One encoder for each worker process and tokenizer file; words: how many pieces it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].words = words
    return _encoders[path]


def portions(texts: list[str], most: int = 4 << 20):
    """Ranges of texts of about that many characters, so that no call holds a whole batch's ids."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
