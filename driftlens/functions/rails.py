"""Ways off the platform: contact and payment rails named in a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.binding import bind
from driftlens.functions.chars import SPACE, WORD_END, WORD_START

# Names and patterns, in order; ASCII word boundaries are written out.
B = f"(?:{WORD_START}|{WORD_END})"
PATTERNS = [
    ("telegram", rf"(?i){B}(?:t\.me/[a-z0-9_]+|telegram\.me/[a-z0-9_]+|on telegram){B}"),
    ("whatsapp", rf"(?i){B}(?:wa\.me/[0-9]+|chat\.whatsapp\.com/[a-z0-9]+|whatsapp){B}"),
    ("discord-invite", rf"(?i){B}(?:discord\.gg|discord\.com/invite)/[a-z0-9]+"),
    ("cashapp", rf"(?i)(?:^|[{SPACE}])\$[a-z][a-z0-9_]{{1,20}}{B}"),
    ("paypal-me", rf"(?i){B}paypal\.me/[a-z0-9]+"),
    ("venmo", rf"(?i){B}venmo{B}"),
    ("crypto-wallet", rf"{B}(?:0x[a-fA-F0-9]{{40}}|bc1[a-z0-9]{{20,60}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}){B}"),
    ("email", rf"{B}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{B}"),
    ("off-platform-dm", rf"(?i){B}(?:dm me|pm me|message me directly|hit me up|contact me directly|link in bio){B}"),
]


# What must stand in the text, in any case, for a pattern to be tried.
SIGNS = {
    "telegram": ["t.me/", "telegram"], "whatsapp": ["wa.me/", "whatsapp"], "discord-invite": ["discord"], "cashapp": ["$"], "paypal-me": ["paypal.me/"], "venmo": ["venmo"], "email": ["@"],
    "off-platform-dm": ["dm me", "pm me", "message me directly", "hit me up", "contact me directly", "link in bio"],
}


def rails(stripped: Column) -> Column:
    """Names of the rails in stripped and folded text, in order."""

    def found(given: Column) -> Column:
        text, low = given["text"], given["low"]

        def sign(name: str) -> Column:
            if name not in SIGNS:
                return text.rlike("[0-9A-Za-z]{23}")
            return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in SIGNS[name]))

        return F.filter(F.array(*(F.when(sign(name) & text.rlike(p), F.lit(name)) for name, p in PATTERNS)), lambda x: x.isNotNull())

    return bind(F.struct(stripped.alias("text"), F.lower(stripped).alias("low")), found)
