"""Links as a table function for Spark SQL: SELECT l.* FROM documents d, LATERAL links(d.text) l.

A row for each place where a text has a link, in the order in which functions.links finds them: form (markdown, dangerous,
reference, autolink, bare, www), href, text, start (code points from 0), and first, which holds for the rows that
functions.links.extract_link_refs keeps: the first of each href. The same patterns, read by Python instead of the JVM, as
places can't be had from the JVM's functions. Null and empty texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlens.functions import chars, links, versions


def _python(pattern: str) -> re.Pattern:
    """A pattern of the JVM's kind; letters are matched in either case within ASCII only, there and here."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern), re.ASCII)


FENCES = [_python(p) for p in links.FENCES]
MARKDOWN, DANGEROUS, DEFINITION, USAGE = map(_python, (links.MARKDOWN, links.MARKDOWN_DANGEROUS, links.DEFINITION, links.USAGE))
PLAIN = [("autolink", _python(links.AUTOLINK), 1, ""), ("bare", _python(links.BARE), 0, ""), ("www", _python(links.BARE_WWW), 0, "https://")]
SPACES = _python(f"[{chars.SPACE}]+")
TAIL = re.compile(r"""[).,!?;:'"]+$""")
SCHEMA = "form string, href string, text string, start int, first boolean"


def _label(text: str) -> str:
    return SPACES.sub(" ", text.lower()).strip(" ")


def every_link(text: str) -> Iterator[tuple[str, str, str, int]]:
    """form, href, text, start of every link, code left out."""
    for fence in FENCES:
        text = fence.sub(lambda m: " " * len(m[0]), text)
    for form, pattern in (("markdown", MARKDOWN), ("dangerous", DANGEROUS)):
        yield from ((form, m[2], m[1], m.start()) for m in pattern.finditer(text))
    known: dict[str, str] = {}
    for m in DEFINITION.finditer(text):
        label, href = _label(m[1]), TAIL.sub("", m[2])
        if label and href:
            known.setdefault(label, href)
    if known:
        for m in USAGE.finditer(text):
            if (label := _label(m[2] or m[1])) in known:
                yield "reference", known[label], m[1], m.start()
    for form, pattern, group, scheme in PLAIN:
        yield from ((form, scheme + m[group], "", m.start()) for m in pattern.finditer(text))


@F.udtf(returnType=SCHEMA, useArrow=True)
class LinkTable:
    def eval(self, text: str):
        seen = set()
        for form, href, label, start in every_link(text or ""):
            if href := TAIL.sub("", href):
                yield form, href, label, start, href not in seen
                seen.add(href)


def register(spark: SparkSession) -> None:
    """links for SQL; deterministic, so that it may stand in an outer join."""
    versions.small_batches(spark)
    spark.udtf.register("links", LinkTable.asDeterministic())
