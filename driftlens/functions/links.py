"""Links of a markdown text, cloaked labels and defanged mentions, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.binding import bind
from driftlens.functions.chars import SPACE, match_form, nfkd_array
from driftlens.functions.urls import registrable_domain

REFS = "array<struct<href:string,text:string>>"
S, NOT_S = f"[{SPACE}]", f"[^{SPACE}"
URL = rf"https?://{NOT_S}<>()\]\"']{{1,2048}}"
WORD = r"(?<![0-9A-Za-z_])"
LINE = r"(?<![^\n\r\x{2028}\x{2029}])"

# Patterns and their bounds.
FENCES = [r"```[\s\S]{0,10000}?```", r"~~~[\s\S]{0,10000}?~~~", r"(`{1,8})([^`]{1,500}?)\1"]
MARKDOWN = rf"(?i)!?\[([^\]]{{0,500}})\]\({S}*<?(https?://[^){SPACE}>]{{1,2048}})>?[^)]{{0,300}}\)"
MARKDOWN_DANGEROUS = rf"(?i)!?\[([^\]]{{0,500}})\]\({S}*((?:javascript:|data:|vbscript:|file:|blob:)[^){SPACE}]{{0,2000}})\)"
DEFINITION = rf"(?i){LINE}[ \t]{{0,3}}\[([^\]]{{1,200}})\]:[ \t]*<?(https?://[^{SPACE}>]{{1,2048}})>?"
USAGE = r"\[([^\]]{0,500})\](?:\[([^\]]{0,200})\])?"
AUTOLINK = rf"(?i)<((?:https?|ftp):[^{SPACE}<>]{{1,2048}})>"
BARE = rf"(?i){WORD}{URL}"
BARE_WWW = rf"(?i){WORD}www\.[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{1,8}}(?:/{NOT_S}<>()\]\"']{{0,2048}})?"
DOMAINISH = r"(?i)[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}"


def strip_trailing_punctuation(href: Column) -> Column:
    return F.regexp_replace(href, r"""[).,!?;:'"]+$""", "")


def mask_code(text: Column) -> Column:
    """Fences, then code spans, replaced by as many spaces."""

    def mask(text: Column, pattern: str) -> Column:
        blank = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.repeat(F.lit(" "), F.length(m)))
        masked = bind(blank, lambda found: F.array_join(F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.get(found, i), F.lit("")))), ""))
        return F.when(F.size(F.regexp_extract_all(text, F.lit(pattern), 0)) > 0, masked).otherwise(text)

    return F.when(text.rlike("`|~~~"), reduce(lambda t, p: bind(t, lambda x: mask(x, p)), FENCES, text)).otherwise(text)


def _pairs(text: Column, pattern: str, href: int, label: int | None) -> Column:
    """A text is searched once; groups are read off what was found, which is all that a match looked at."""
    if label is None:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), href), lambda h: F.struct(h.alias("href"), F.lit("").alias("text")))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, href).alias("href"), F.regexp_extract(m, pattern, label).alias("text")))


def _label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), f"{S}+", " "))


def reference_links(text: Column) -> Column:
    """Usages [text][label], [label][] and [label] of definitions, the first of which holds."""
    defined = F.transform(_pairs(text, DEFINITION, 2, 1), lambda d: F.struct(_label(d["text"]).alias("label"), strip_trailing_punctuation(d["href"]).alias("href")))
    defined = F.filter(defined, lambda d: (d["label"] != "") & (d["href"] != ""))

    def resolve(known: Column) -> Column:
        href = lambda u: bind(_label(F.when(u["href"] != "", u["href"]).otherwise(u["text"])), lambda name: F.get(F.filter(known, lambda d: d["label"] == name), F.lit(0))["href"])
        used = F.filter(F.transform(_pairs(text, USAGE, 2, 1), lambda u: F.struct(href(u).alias("href"), u["text"].alias("text"))), lambda r: r["href"].isNotNull())
        return F.when(F.size(known) > 0, used).otherwise(F.array().cast(REFS))

    return F.when(F.contains(text, F.lit("]:")), bind(defined, resolve)).otherwise(F.array()).cast(REFS)


def extract_link_refs(body: Column) -> Column:
    """Links in order of kind, then place, each href once (the first keeps its text). Texts without a sign of any
    link skip the patterns."""

    def every(text: Column) -> Column:
        www = F.transform(_pairs(text, BARE_WWW, 0, None), lambda r: F.struct(F.concat(F.lit("https://"), r["href"]).alias("href"), r["text"].alias("text")))
        found = F.concat(_pairs(text, MARKDOWN, 2, 1), _pairs(text, MARKDOWN_DANGEROUS, 2, 1), reference_links(text), _pairs(text, AUTOLINK, 1, None), _pairs(text, BARE, 0, None), www)
        return F.filter(F.transform(found, lambda r: F.struct(strip_trailing_punctuation(r["href"]).alias("href"), r["text"].alias("text"))), lambda r: r["href"] != "")

    once = lambda refs: bind(F.transform(refs, lambda r: r["href"]), lambda hrefs: F.filter(refs, lambda r, i: F.array_position(hrefs, r["href"]) == i + 1))
    sign = F.coalesce(body, F.lit("")).rlike(r"(?i)://|www\.|\]\(|<ftp:|<https?:")
    return F.when(sign, bind(bind(mask_code(body), every), once)).otherwise(F.array()).cast(REFS)


def extract_links(body: Column) -> Column:
    return F.transform(extract_link_refs(body), lambda r: r["href"])


def domains_of(parsed: Column) -> Column:
    """Distinct registrable domains of parsed URLs, first seen first."""
    return F.array_distinct(F.filter(F.transform(parsed, lambda p: registrable_domain(p["host"])), lambda d: d != ""))


def new_items(before: Column, after: Column) -> Column:
    """Items of after that before lacks; repeats stay."""
    return F.filter(after, lambda x: ~F.array_contains(before, x))


def defang(text: Column) -> Column:
    """Domain mentions written so as not to be links, rewritten as domains."""
    word = r"(?<![0-9A-Za-z_])"
    text = F.regexp_replace(text, rf"(?i){word}hxxps(?![0-9A-Za-z_])", "https")
    text = F.regexp_replace(text, rf"(?i){word}hxxp(?![0-9A-Za-z_])", "http")
    text = F.regexp_replace(text, rf"[\[({{]{S}*\.{S}*[\])}}]", ".")
    text = F.regexp_replace(text, rf"(?i)(?<=[a-z0-9]){S}+\.{S}+(?=[a-z0-9])", ".")
    text = F.regexp_replace(text, rf"(?i)(?<=[a-z0-9]){S}*\({S}*dot{S}*\){S}*(?=[a-z0-9])", ".")
    return F.regexp_replace(text, rf"(?i)(?<=[a-z0-9]){S}+dot{S}+(?=[a-z0-9])", ".")


def label_forms(refs: Column) -> Column:
    """Of each link: its label, defanged, in match form."""
    return F.transform(nfkd_array(F.transform(refs, lambda r: defang(r["text"]))), match_form)


def cloaked(label_form: Column, host: Column) -> Column:
    """The label shows a domain other than the destination's."""
    shown, goes = registrable_domain(F.regexp_extract(label_form, DOMAINISH, 0)), registrable_domain(host)
    return (shown != "") & (goes != "") & (shown != goes)
