"""Drift score of edits: four categories joined by noisy-OR, a band, and ordered reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import links, urls, versions
from driftlens.functions.lookalike import deglyph, find_lookalike, near_brands


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def noisy_or(*parts: Column) -> Column:
    return 1 - reduce(lambda a, b: a * b, (1 - clamp(p) for p in parts))


def noisy_or_of(part: Column) -> Column:
    """The same over the rows of a group, an aggregate."""
    return 1 - F.product(1 - clamp(part))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.55, "medium").when(score >= 0.30, "low").otherwise("none")


def percent(x: Column) -> Column:
    """Rounded half up, as text."""
    return F.floor(x * 100 + 0.5).cast("string")


def structural(net: Column, added: Column, late: Column) -> Column:
    """Rewriting, new text and late edits; capped low on purpose."""
    rewritten = F.when(net > 0.4, 0.4 * clamp((net - 0.4) / 0.6)).otherwise(0.0)
    return noisy_or(rewritten, F.when(added > 0.5, 0.3 * clamp((added - 0.5) / 0.5)).otherwise(0.0), F.when(late, 0.2).otherwise(0.0))


def obfuscation(invisible: Column, bidi: Column, confusable: Column) -> Column:
    """Each flag: present now, absent before."""
    return noisy_or(F.when(invisible, 0.4).otherwise(0.0), F.when(bidi, 0.75).otherwise(0.0), F.when(confusable, 0.5).otherwise(0.0))


def solicitation(n_new: Column) -> Column:
    return F.when(n_new > 0, 1 - F.exp(-0.5 * n_new)).otherwise(0.0)


def link_score(n_links: Column, n_domains: Column, n_dangerous: Column, risk: Column, lookalike: Column, cloaked: Column) -> Column:
    base = F.when(n_domains > 0, 0.75).when(n_links > 0, 0.6).otherwise(0.0)
    return noisy_or(base, 1 - F.pow(F.lit(0.05), n_dangerous), risk, F.when(lookalike, 0.9).otherwise(0.0), F.when(cloaked, 0.85).otherwise(0.0))


def with_features(edits: DataFrame) -> DataFrame:
    """The rows of edits, each in one struct (edit), and beside it what the score needs. edits: approved_body,
    current_body, approved_links (array<string>), current_refs (array<struct<href,text>>), minutes_since_approval,
    late_edit_hours."""
    df = edits.select(F.struct(*(F.col(f"`{c}`") for c in edits.columns)).alias("edit"))
    df = df.withColumn("texts", versions.compared(F.col("edit.approved_body"), F.col("edit.current_body")))
    new = lambda flag: F.col(f"texts.{flag}_after") & ~F.col(f"texts.{flag}_before")
    df = df.withColumns({"new_rails": F.array_except("texts.rails_after", "texts.rails_before"), **{f"new_{flag}": new(flag) for flag in versions.FLAGS}})

    df = df.withColumn("_refs", F.col("edit.current_refs")).withColumn("_hrefs", F.transform("_refs", lambda r: r["href"]))
    df = df.withColumn("added_links", links.new_items(F.coalesce("edit.approved_links", F.array().cast("array<string>")), F.col("_hrefs")))
    df = df.withColumns({"_parsed": urls.parse_urls("_hrefs"), "_parsed_before": urls.parse_urls("edit.approved_links"), "_labels": links.label_forms(F.col("_refs"))})
    df = df.withColumn("added_domains", links.new_items(links.domains_of(F.col("_parsed_before")), links.domains_of(F.col("_parsed"))))

    # a link: its parts, label, whether it is dangerous or new, and its registrable domain in Unicode
    def link(href: Column, i: Column) -> Column:
        parts = F.get("_parsed", i)
        domain = urls.registrable_domain(parts["host"])
        labels = F.split(parts["decoded"], r"\.")
        k = F.size(F.split(domain, r"\."))
        shown = F.when(domain == "", "").when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")).otherwise(domain)
        return F.struct(href.alias("href"), parts.alias("parts"), F.get("_labels", i).alias("label"), urls.dangerous_scheme(href).alias("danger"), F.array_contains("added_links", href).alias("new"), shown.alias("domain"))

    df = df.withColumn("_links", F.transform("_hrefs", link))
    df = df.withColumn("_new", F.filter("_links", lambda x: x["new"] & ~x["danger"]))
    df = df.withColumn("_near", near_brands(F.transform("_new", lambda x: deglyph(F.substring_index(x["domain"], ".", 1)))))
    risks = F.transform("_new", lambda x: urls.url_risk(x["href"], x["parts"]))
    df = df.withColumn("_risks", F.transform(risks, lambda r: F.struct(r["score"].alias("score"), F.get(r["reasons"], F.lit(0)).alias("reason"))))
    df = df.withColumn("max_risk", F.coalesce(F.array_max(F.transform("_risks", lambda r: r["score"])), F.lit(0.0)))
    df = df.withColumn("risk_reason", F.get(F.filter("_risks", lambda r: r["score"] == F.col("max_risk")), F.lit(0))["reason"])
    hits = F.transform("_new", lambda x, i: F.when(F.contains(x["domain"], F.lit(".")), find_lookalike(F.substring_index(x["domain"], ".", 1), x["domain"], F.get("_near", i))["reason"]))
    df = df.withColumn("lookalike", F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)))
    df = df.withColumn("cloaked", F.get(F.filter("_links", lambda x: links.cloaked(x["label"], x["parts"]["host"])), F.lit(0))["href"])
    df = df.withColumn("dangerous", F.transform(F.filter("_links", lambda x: x["danger"]), lambda x: F.substring_index(x["href"], ":", 1)))
    return df.withColumn("late", (F.col("edit.late_edit_hours") > 0) & (F.col("edit.minutes_since_approval") > F.col("edit.late_edit_hours") * 60))


def score_drift(edits: DataFrame) -> DataFrame:
    """The columns of edits and link, solicitation, obfuscation, structural, score, band, signals, added_links,
    added_domains. A column of edits with one of these names is replaced; others stay as they are."""
    df = with_features(edits)
    net, added = 1 - F.col("texts.similarity"), F.col("texts.added_fraction")
    df = df.withColumns({
        "link": link_score(F.size("added_links"), F.size("added_domains"), F.size("dangerous"), F.col("max_risk"), F.col("lookalike").isNotNull(), F.col("cloaked").isNotNull()),
        "solicitation": solicitation(F.size("new_rails")), "obfuscation": obfuscation(F.col("new_invisible"), F.col("new_bidi"), F.col("new_confusable")),
        "structural": structural(net, added, F.col("late")),
    })
    df = df.withColumn("score", noisy_or(F.col("link"), F.col("solicitation"), F.col("obfuscation"), F.col("structural"))).withColumn("band", band(F.col("score")))
    # What is said of each signal, in order.
    one = lambda when, *text: F.when(when, F.array(F.concat(*text))).otherwise(F.array().cast("array<string>"))
    first = lambda c: F.get(F.col(c), F.lit(0))
    signals = F.concat(
        one(F.size("added_links") > 0, F.lit("new link added after approval: "), first("added_links")),
        one(F.size("added_domains") > 0, F.lit("new destination domain not in approved version: "), first("added_domains")),
        F.transform("dangerous", lambda d: F.concat(F.lit("dangerous URL scheme used: "), d, F.lit(":"))),
        one((F.col("max_risk") > 0) & F.col("risk_reason").isNotNull(), F.lit("risky new link — "), F.col("risk_reason")),
        one(F.col("lookalike").isNotNull(), F.lit("brand look-alike: "), F.col("lookalike")),
        one(F.col("cloaked").isNotNull(), F.lit("cloaked link: the visible text shows a different domain than where it goes ("), F.col("cloaked"), F.lit(")")),
        one(F.size("new_rails") > 0, F.lit("new off-platform solicitation: "), F.array_join("new_rails", ", ")),
        one(F.col("new_invisible"), F.lit("hidden/invisible characters added after approval")),
        one(F.col("new_bidi"), F.lit("bidi/Trojan-Source control characters added after approval")),
        one(F.col("new_confusable"), F.lit("homoglyph (look-alike) characters added after approval")),
        one(net > 0.4, F.lit("body substantially rewritten ("), percent(net), F.lit("% net change)")),
        one(added > 0.5, percent(added), F.lit("% of current text was added after approval")),
        one(F.col("late"), F.lit("edited ~"), F.floor(F.col("edit.minutes_since_approval") / 60 + 0.5).cast("string"), F.lit("h after approval")),
    )
    kept = ["link", "solicitation", "obfuscation", "structural", "score", "band", "signals", "added_links", "added_domains"]
    return df.withColumn("signals", signals).select(*(F.col(f"edit.`{c}`") for c in edits.columns if c not in kept), *kept)
