"""What is read off the texts of two versions, in one Arrow pass over both.

The Column functions of chars, similarity and rails say the same of one text; over whole tables their lambdas and
character classes are interpreted by the JVM for every character, where a string method here looks at a text at once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import chars, dims, rails

FLAGS = ("invisible", "bidi", "confusable")
PROFILE = T.StructType([T.StructField(f, T.DoubleType()) for f in ("similarity", "added_fraction", "removed_fraction")])
JACCARDS = T.StructType([T.StructField(f, T.DoubleType()) for f in ("tokens", "bigrams")])
RAILS = T.StructType([T.StructField(f"rails_{side}", T.ArrayType(T.StringType())) for side in ("before", "after")])
COMPARED = T.StructType([*PROFILE, *(T.StructField(f"rails_{side}", T.ArrayType(T.StringType())) for side in ("before", "after")), *(T.StructField(f"{f}_{side}", T.BooleanType()) for side in ("before", "after") for f in FLAGS)])


#: What one Arrow batch of texts may hold. Python needs several times as much for the strings and sets it makes of them, in each
#: of an executor's workers, so the rows of a batch mustn't grow with those of a task.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands texts to Python in batches of BATCH bytes at most; a lesser limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH:
        spark.conf.set(name, str(BATCH))


def _pattern(text: str, flags: int = re.ASCII) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", text), flags)


_INVISIBLE, _HIDDEN, _BIDI = (_pattern(f"[{c}]") for c in (chars.INVISIBLE, chars.INVISIBLE + chars.COMBINING, chars.BIDI))
_CONTROLS = _pattern(f"[{chars.CONTROLS}]")
_CONFUSABLE, _FOLDS = _pattern(chars.CONFUSABLE), str.maketrans(dims.CONFUSABLES)
_RAILS = [(name, rails.SIGNS.get(name), _pattern(p)) for name, p in rails.PATTERNS]
_LONG = re.compile("[0-9A-Za-z]{23}")


def _shown(text: str, form: str, hidden: re.Pattern) -> str:
    """Without hidden characters, folded; of a normal form."""
    if text.isascii():
        return _CONTROLS.sub("", text)
    text = hidden.sub("", unicodedata.normalize(form, text))
    return text.translate(_FOLDS) if _CONFUSABLE.search(text) else text


def words(text: str) -> list[str]:
    """As similarity.tokens of the match form."""
    return _shown(text, "NFKD", _HIDDEN).lower().split()


def match_of(text: str) -> str:
    """As chars.normalize_for_match."""
    return " ".join(words(text))


def rails_of(text: str) -> list[str]:
    """As rails.rails of the strip form."""
    text = _shown(text, "NFKC", _INVISIBLE)
    low = text.lower()
    return [name for name, signs, p in _RAILS if (any(s in low for s in signs) if signs else _LONG.search(text)) and p.search(text)]


def flags_of(text: str) -> tuple[bool, bool, bool]:
    if text.isascii():
        return bool(_CONTROLS.search(text)), False, False
    return bool(_INVISIBLE.search(text)), bool(_BIDI.search(text)), bool(_CONFUSABLE.search(unicodedata.normalize("NFKC", text)))


def _jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _shingles(w: list[str]) -> set:
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


def jaccards(before: str, after: str) -> tuple[float, float]:
    """As similarity.jaccard of the distinct words, and of the shingles."""
    if before == after:
        return 1.0, 1.0
    a, b = words(before), words(after)
    return _jaccard(set(a), set(b)), _jaccard(_shingles(a), _shingles(b))


def profile(before: str, after: str) -> tuple[float, float, float]:
    """As similarity.change_profile of the words."""
    if before == after:
        return 1.0, 0.0, 0.0
    a, b = words(before), words(after)
    x, y = set(a), set(b)
    both = len(x & y)
    return 0.5 * _jaccard(x, y) + 0.5 * _jaccard(_shingles(a), _shingles(b)), 1 - both / len(y) if y else 0.0, 1 - both / len(x) if x else 0.0


@F.pandas_udf(PROFILE)
def _profile(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile(a, b) for a, b in zip(before, after)], columns=PROFILE.names)


@F.pandas_udf(T.StringType())
def _matched(texts: pd.Series) -> pd.Series:
    return texts.map(match_of)


@F.pandas_udf(JACCARDS)
def _jaccards(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jaccards(a, b) for a, b in zip(before, after)], columns=JACCARDS.names)


@F.pandas_udf(RAILS)
def _rails(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(before, after):
        named = rails_of(a)
        rows.append((named, named if a == b else rails_of(b)))
    return pd.DataFrame(rows, columns=RAILS.names)


@F.pandas_udf(COMPARED)
def _compared(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(before, after):
        named, flags = rails_of(a), flags_of(a)
        rows.append((*profile(a, b), named, named if a == b else rails_of(b), *flags, *(flags if a == b else flags_of(b))))
    return pd.DataFrame(rows, columns=COMPARED.names)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def matched(text: Column) -> Column:
    """The match form of a text."""
    return _matched(_text(text))


def jaccard(before: Column, after: Column) -> Column:
    """Struct of the Jaccard similarities of two texts: tokens, bigrams."""
    return _jaccards(_text(before), _text(after))


def rails_in(before: Column, after: Column) -> Column:
    """Struct of the rails of either text."""
    return _rails(_text(before), _text(after))


def change_profile(before: Column, after: Column) -> Column:
    """Struct of similarity, added_fraction, removed_fraction of two texts."""
    return _profile(_text(before), _text(after))


def compared(before: Column, after: Column) -> Column:
    """The change profile, the rails of either text, and whether each holds invisible, bidi or confusable characters."""
    return _compared(_text(before), _text(after))
