"""Text normalisation and character classes as Column functions.

Only the two Unicode normal forms need Python (Spark has none); everything else stays in the JVM. White space and
word boundaries follow ECMAScript, so their classes are spelt out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import dims
from driftlens.functions.binding import bind

# Code points and ranges, as the inside of a regular expression class.
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{061C}"
ZERO_WIDTH = r"\x{00AD}\x{180E}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FFF9}-\x{FFFB}\x{2800}"
TAGS = r"\x{E0000}-\x{E007F}"
CONTROLS = r"\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}"
COMBINING = r"\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
INVISIBLE = BIDI + ZERO_WIDTH + TAGS + CONTROLS
SPACE = r"\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LATIN = r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}\x{0250}-\x{02AF}"
SCRIPTS = {
    "Cyrillic": r"\x{0400}-\x{04FF}\x{0500}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}", "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}", "Armenian": r"\x{0530}-\x{058F}",
    "Cherokee": r"\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}", "Coptic": r"\x{2C80}-\x{2CFF}",
}
WORD_START, WORD_END = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])", r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"
CONFUSABLE = "[" + "".join(dims.CONFUSABLES) + "]"


def _form(name: str):
    def one(s: str | None) -> str | None:
        return s if s is None or s.isascii() else unicodedata.normalize(name, s)

    @F.pandas_udf(T.StringType())
    def text(col: pd.Series) -> pd.Series:
        return col.map(one, na_action="ignore")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def array(col: pd.Series) -> pd.Series:
        return col.map(lambda a: None if a is None else [one(s) for s in a])

    return text, array


nfkc, nfkc_array = _form("NFKC")
nfkd, nfkd_array = _form("NFKD")


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip_invisible(col: Column | str, combining: bool = False) -> Column:
    return F.regexp_replace(_text(col), f"[{INVISIBLE}{COMBINING if combining else ''}]", "")


def fold_confusables(col: Column | str) -> Column:
    one = {k: v for k, v in dims.CONFUSABLES.items() if len(v) == 1}
    col = _text(col)
    for k, v in dims.CONFUSABLES.items():
        if k not in one:
            col = F.replace(col, F.lit(k), F.lit(v))
    return F.translate(col, "".join(one), "".join(one.values()))


def match_form(decomposed: Column | str) -> Column:
    """From NFKD text: without invisible and combining characters, folded, lower case, single spaces."""
    folded = F.lower(fold_confusables(strip_invisible(decomposed, combining=True)))
    return F.trim(F.regexp_replace(folded, f"[{SPACE}]+", " "))


def normalize_for_match(col: Column | str) -> Column:
    return match_form(nfkd(_text(col)))


def strip_form(composed: Column | str) -> Column:
    """From NFKC text: without invisible characters, folded, case kept."""
    return fold_confusables(strip_invisible(composed))


def strip_and_fold(col: Column | str) -> Column:
    return strip_form(nfkc(_text(col)))


def contains_invisible(col: Column | str) -> Column:
    return _text(col).rlike(f"[{INVISIBLE}]")


def contains_bidi(col: Column | str) -> Column:
    return bind(_text(col), lambda t: t.rlike("[^\\x00-\\x7F]") & t.rlike(f"[{BIDI}]"))


def has_confusable(composed: Column | str) -> Column:
    """Of NFKC text. Removing them shows it: a lookup for each character, where a class of over a hundred would be
    tried one by one."""
    return bind(_text(composed), lambda t: t.rlike("[^\\x00-\\x7F]") & (F.length(F.translate(t, "".join(dims.CONFUSABLES), "")) < F.length(t)))


def contains_confusable(col: Column | str) -> Column:
    return has_confusable(nfkc(_text(col)))


def script_mix(composed: Column | str) -> Column:
    """Of NFKC text: the first confusable script that stands beside Latin letters, or ''."""
    col = _text(composed)
    first = F.regexp_extract(col, "[" + "".join(SCRIPTS.values()) + "]", 0)
    name = F.lit("")
    for script, inside in SCRIPTS.items():
        name = F.when(first.rlike(f"[{inside}]"), script).otherwise(name)
    return F.when(col.rlike(f"[{LATIN}]"), name).otherwise("")


def mixed_script(col: Column | str) -> Column:
    return script_mix(nfkc(_text(col)))
