"""URLs: registrable domains, canonical form and risk.

One Arrow UDF parses the URLs of a row (a WHATWG subset: Spark's parser is java.net.URI, which refuses what a browser
accepts); what is derived from the parts is Column code.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import chars, dims
from driftlens.functions.binding import bind

MAX_URL, MAX_PASSES, MAX_LABEL = 4096, 10, 256
DANGEROUS = f"(?i)^[{chars.SPACE}]*(javascript|data|vbscript|file|blob):"
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
STRINGS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
CANONICAL = T.StructType([*STRINGS("href", "hostname", "pathname", "search", "scheme", "username"), T.StructField("is_ip_host", T.BooleanType()), T.StructField("decode_passes", T.IntegerType()), *STRINGS("decoded", "decoded_nfkc")])
PARSED = T.StructType([*STRINGS("host", "decoded", "decoded_nfkc"), T.StructField("canonical", CANONICAL)])


# ---- small helpers that run inside the UDF --------------------------------------------------------------------------
def puny_decode(label: str) -> str | None:
    """RFC 3492 decoding of a label without its prefix; None if it is malformed or over 256 characters."""
    if len(label) > MAX_LABEL:
        return None
    dash = label.rfind("-")
    basic, rest = (label[:dash], label[dash + 1 :]) if dash > 0 else ("", label)
    if not basic.isascii():
        return None
    out, n, i, bias = list(basic), 128, 0, 72
    digits = iter(rest)
    for c in digits:
        before, weight, k = i, 1, 36
        while True:
            d = "abcdefghijklmnopqrstuvwxyz0123456789".find(c.lower()) if c.isascii() else -1
            if d < 0 or d > (0x7FFFFFFF - i) // weight:
                return None
            i += d * weight
            t = min(max(k - bias, 1), 26)
            if d < t:
                break
            if weight > 0x7FFFFFFF // (36 - t):
                return None
            weight, k = weight * (36 - t), k + 36
            if (c := next(digits, None)) is None:
                return None
        size = len(out) + 1
        delta = (i - before) // (700 if before == 0 else 2)
        delta, bias = delta + delta // size, 0
        while delta > 455:
            delta, bias = delta // 35, bias + 36
        bias += 36 * delta // (delta + 38)
        n, i = n + i // size, i % size
        if n > 0x10FFFF:
            return None
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def decode_host(host: str) -> str:
    """Labels with the punycode prefix in Unicode; what can't be decoded stays."""
    if "xn--" not in host.lower():
        return host
    found = ((label, puny_decode(label[4:])) if label.lower().startswith("xn--") else (label, None) for label in host.split("."))
    return ".".join(label if plain is None else plain for label, plain in found)


def radix(s: str) -> int | None:
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", s):
        return int(s, 16)
    if re.fullmatch(r"0[0-7]+", s):
        return int(s, 8)
    return int(s) if re.fullmatch(r"[0-9]{1,400}", s) else None


def ipv4(host: str) -> str | None:
    """Dotted form of a host that is an IPv4 address in decimal, octal or hexadecimal, of one to four parts."""
    host = host.rstrip(".")
    if not host:
        return None
    parts = host.split(".")
    if len(parts) > 4:
        return None
    numbers = [radix(p) for p in parts]
    if any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    last = numbers[-1].to_bytes(5 - len(parts), "big")
    return ".".join(map(str, [*numbers[:-1], *last]))


def percent_decode(s: str) -> tuple[str, int]:
    """Decoded until nothing changes, a pass is malformed, or ten passes; and the passes that changed something."""
    for passes in range(MAX_PASSES):
        if re.search(r"%(?![0-9a-fA-F]{2})", s):
            return s, passes
        try:
            new = unquote_to_bytes(s).decode()
        except UnicodeError:
            return s, passes
        if new == s:
            return s, passes
        s = new
    return s, MAX_PASSES


def ascii_host(host: str) -> str | None:
    """The host as a URL holds it: decoded, mapped, in punycode, IPv4 in dotted form; None if it can't be one."""
    if host.startswith("["):
        return host.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", host) and host.count(":") >= 2 else None
    try:
        host = unquote_to_bytes(host).decode()
    except UnicodeError:
        return None
    host = unicodedata.normalize("NFKC", "".join(c for c in host.lower() if c not in "­​⁠﻿")).lower().replace("。", ".")
    labels = []
    for label in host.split("."):
        try:
            labels.append(label if label.isascii() else "xn--" + label.encode("punycode").decode())
        except UnicodeError:
            return None
    host = ".".join(labels)
    if not host or FORBIDDEN.search(host):
        return None
    last = host.rstrip(".").rsplit(".", 1)[-1]
    if re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", last):
        return ipv4(host)
    return host


def split_url(url: str) -> dict | None:
    """Parts of a URL as a browser reads it; None if it isn't one."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", url, re.S)
    if not m:
        return None
    scheme, rest = m[1].lower(), m[2].partition("#")[0]
    special = scheme in PORTS
    out = {"scheme": scheme, "username": "", "password": "", "host": "", "port": "", "path": "", "search": ""}
    rest, mark, search = rest.partition("?")
    out["search"] = mark + search if search else ""
    if special:
        rest = rest.replace("\\", "/").lstrip("/")
    elif rest.startswith("//"):
        rest = rest[2:]
    else:  # no authority
        return out | {"path": rest}
    authority, slash, path = rest.partition("/")
    user, at, host = authority.rpartition("@")
    if at:
        out["username"], _, out["password"] = user.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", host)
    if not m or (special and not m[1]) or (m[2] and int(m[2]) > 65535):
        return None
    found = ascii_host(m[1]) if special else m[1]
    if found is None:
        return None
    port = str(int(m[2])) if m[2] else ""
    return out | {"host": found, "port": "" if PORTS.get(scheme) == port else port, "path": slash + path if slash else "/" if special else ""}


def dotless(path: str) -> str:
    """Without empty, '.' and '..' segments; a leading and a trailing slash stay."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out) + ("/" if len(path) > 1 and path.endswith("/") else "")


def canonical(raw: str) -> dict | None:
    if not raw or len(raw) > MAX_URL:
        return None
    text, passes = percent_decode(re.sub(r"[\t\n\r]", "", raw).strip().partition("#")[0])
    parts = split_url(text)
    if parts is None:
        return None
    host = re.sub(r"^\.|\.$", "", re.sub(r"\.+", ".", parts["host"].lower()))
    address = ipv4(host)
    host = address or host
    path = dotless(re.sub(r"/{2,}", "/", parts["path"] or "/")) or "/"
    search = parts["search"].removeprefix("?")
    user = parts["username"] and parts["username"] + (":" + parts["password"] if parts["password"] else "") + "@"
    decoded = decode_host(host)
    return {
        "href": f"{parts['scheme']}://{user}{host}{':' + parts['port'] if parts['port'] else ''}{path}{'?' + search if search else ''}",
        "hostname": host, "pathname": path, "search": search, "scheme": parts["scheme"], "username": parts["username"],
        "is_ip_host": address is not None or host.startswith("[") or ":" in host, "decode_passes": passes,
        "decoded": decoded, "decoded_nfkc": unicodedata.normalize("NFKC", decoded),
    }


def parse(url: str | None) -> dict:
    parts = split_url(url or "")
    host = parts["host"] if parts else ""
    decoded = decode_host(host)
    return {"host": host, "decoded": decoded, "decoded_nfkc": unicodedata.normalize("NFKC", decoded), "canonical": canonical(url or "")}


@F.pandas_udf(T.ArrayType(PARSED))
def parse_urls(urls: pd.Series) -> pd.Series:
    """Parts of every URL of an array, in its order."""
    return urls.map(lambda a: [parse(u) for u in a] if a is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_hosts(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda a: None if a is None else [None if h is None else decode_host(h) for h in a])


@F.pandas_udf(T.StringType())
def canonical_ipv4(hosts: pd.Series) -> pd.Series:
    return hosts.map(ipv4, na_action="ignore")


@F.pandas_udf(T.StringType())
def punycode_label(labels: pd.Series) -> pd.Series:
    return labels.map(puny_decode, na_action="ignore")


# ---- Column functions -----------------------------------------------------------------------------------------------
def labels_of(host: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\."), lambda x: x != "")


def registrable_domain(host: Column) -> Column:
    """The longest known suffix of two to four labels and one label more; else the last two labels."""

    def longest(labels: Column) -> Column:
        n = F.size(labels)
        last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
        found = last(2)
        for k in (2, 3, 4):
            own = [s for s in dims.SUFFIXES if s.count(".") == k - 1]
            found = F.when((n > k) & last(k).isin(own), last(k + 1)).otherwise(found)
        return found

    return bind(labels_of(F.coalesce(host, F.lit(""))), longest)


def match_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds suffix and kind: the longest suffix of two to four labels that a host stands below, by a join with a table of
    suffixes (suffix, kind) of any size; null where there is none. hosts: host and more; each different row once."""
    labels = labels_of(F.coalesce("host", F.lit("")))
    tried = hosts.distinct().withColumn("_k", F.explode(F.array(*(F.lit(k) for k in (2, 3, 4))))).withColumn("_l", labels).filter(F.size("_l") > F.col("_k"))
    tried = tried.select(*hosts.columns, "_k", F.array_join(F.slice("_l", -F.col("_k"), F.col("_k")), ".").alias("suffix"))
    best = tried.join(suffixes, "suffix").groupBy(*hosts.columns).agg(F.max(F.struct("_k", "suffix", "kind")).alias("_b"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in hosts.columns]
    return hosts.distinct().alias("h").join(best.alias("b"), same, "left").select("h.*", "b._b.suffix", "b._b.kind")


def dangerous_scheme(href: Column) -> Column:
    return href.rlike(DANGEROUS)


def url_risk(href: Column, parsed: Column) -> Column:
    """Struct of twelve flags, score, reasons (in fixed order) and canonical_host."""
    c = parsed["canonical"]
    host, label = F.coalesce(c["hostname"], F.lit("")), lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), r"\."), lambda x: x != "")
    given = F.struct(
        c.alias("c"), host.alias("host"), label(host).alias("labels"), label(c["decoded_nfkc"]).alias("decoded"), registrable_domain(host).alias("domain"),
        F.coalesce(c["username"], F.lit("")).alias("user"), dangerous_scheme(href).alias("danger"),
    )
    return bind(bind(given, _flags), _risk)


def _flags(g: Column) -> Column:
    c, host, labels, domain, user, danger = (g[k] for k in ("c", "host", "labels", "domain", "user", "danger"))
    tld = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))
    flags = {
        "shortener": domain.isin(dims.SHORTENERS), "ip_host": c["is_ip_host"], "punycode": F.exists(labels, lambda x: x.startswith("xn--")), "credentials": user != "",
        "userinfo_domain": user.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"), "suspicious_tld": tld.isin(dims.SUSPICIOUS_TLDS), "many_subdomains": F.size(labels) - F.size(F.split(domain, r"\.")) >= 3,
        "confusable_host": chars.has_confusable(c["decoded_nfkc"]), "mixed_script_host": F.exists(g["decoded"], lambda x: chars.script_mix(x) != ""),
        "host_trust_token": host.rlike("|".join(dims.TRUST_TOKENS)), "double_encoded": c["decode_passes"] > 1,
    }
    flags = {k: F.coalesce(c.isNotNull() & ~danger & v, F.lit(False)) for k, v in flags.items()} | {"dangerous_scheme": danger}
    return F.struct(*(v.alias(k) for k, v in flags.items()), host.alias("host"), domain.alias("domain"), user.alias("user"), tld.alias("tld"))


def _risk(g: Column) -> Column:
    domain, user, tld = (g[k] for k in ("domain", "user", "tld"))
    # What is said of each flag, in order.
    said = {
        "dangerous_scheme": F.lit("dangerous URL scheme (javascript/data/vbscript/file/blob)"), "shortener": F.concat(F.lit("URL shortener ("), domain, F.lit(") hides the destination")), "ip_host": F.lit("links to a raw IP address"),
        "punycode": F.lit("punycode host (possible homograph domain)"), "credentials": F.lit("credentials embedded in the URL"), "userinfo_domain": F.concat(F.lit("'@'-trick: userinfo '"), user, F.lit("' looks like a domain")),
        "suspicious_tld": F.concat(F.lit("high-abuse TLD (."), tld, F.lit(")")), "many_subdomains": F.lit("unusually deep subdomain nesting"), "confusable_host": F.lit("homoglyph characters in the domain"),
        "mixed_script_host": F.lit("mixed-script domain label (Latin + non-Latin)"), "host_trust_token": F.lit("phishing-style trust word in the hostname"), "double_encoded": F.lit("URL was double-encoded (intentional obfuscation)"),
    }
    raw = F.lit(0.0)
    for k in said:
        raw = raw + F.when(g[k], dims.RISK_WEIGHTS[k]).otherwise(0.0)
    reasons = F.filter(F.array(*(F.when(g[k], text) for k, text in said.items())), lambda x: x.isNotNull())
    return F.struct(*(g[k].alias(k) for k in said), (1 - F.exp(-raw)).alias("score"), reasons.alias("reasons"), F.when(g["dangerous_scheme"], "").otherwise(g["host"]).alias("canonical_host"))
