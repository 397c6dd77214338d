"""Registered queries of the drift engine, each over whole tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.config import Settings
from driftlens.functions import chars, dims, links, lookalike, rails, urls
from driftlens.functions import versions as pairs
from driftlens.operators import brands, log, score, watch
from driftlens.plans.registry import registry
from driftlens.plans.edits import NOW, VERSIONS_SQL, edits, versions
from driftlens.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registry(QUERIES, ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# ---- SQL text shared by the oracles ----------------------------------------------------------------------------------
def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _class(text: str) -> str:
    return text.replace("\\x{", "\\x{")


def _labels(host: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({host}), '\\.+$', ''), '.'), lambda x: x <> '')"


def _domain(labels: str) -> str:
    """Registrable domain of a list of labels."""
    last = lambda k: f"array_to_string({labels}[-{k}:], '.')"
    at = [_in([s for s in dims.SUFFIXES if s.count(".") == k - 1]) for k in (2, 3, 4)]
    return f"CASE WHEN len({labels}) > 4 AND {last(4)} IN {at[2]} THEN {last(5)} WHEN len({labels}) > 3 AND {last(3)} IN {at[1]} THEN {last(4)} WHEN len({labels}) > 2 AND {last(2)} IN {at[0]} THEN {last(3)} ELSE {last(2)} END"


_ONE = {k: v for k, v in dims.CONFUSABLES.items() if len(v) == 1}
_FOLD = lambda x: f"translate(replace({x}, 'ы', 'bl'), '{''.join(_ONE)}', '{''.join(_ONE.values())}')"
_MATCH = lambda x: f"trim(regexp_replace(lower({_FOLD(f'''regexp_replace(strip_accents({x}), '[{chars.INVISIBLE}{chars.COMBINING}]', '', 'g')''')}), '[{chars.SPACE}]+', ' ', 'g'))"
_STRIP = lambda x: _FOLD(f"regexp_replace({x}, '[{chars.INVISIBLE}]', '', 'g')")
_WORDS = lambda x: f"list_filter(string_split({_MATCH(x)}, ' '), lambda x: x <> '')"
_SHINGLES = lambda w: f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) = 1 THEN {w} ELSE list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])) END"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


_MISSING = lambda a, b: f"CASE WHEN len({b}) = 0 THEN 0.0 ELSE 1 - len(list_intersect({a}, {b}))::DOUBLE / len({b}) END"
PROFILE = f"""{VERSIONS_SQL}, w AS (SELECT doc_id, t, c, {_WORDS('t')} AS a, {_WORDS('c')} AS b FROM e),
    s AS (SELECT *, list_distinct(a) AS x, list_distinct(b) AS y, {_SHINGLES('a')} AS sa, {_SHINGLES('b')} AS sb FROM w),
    p AS (SELECT doc_id, t, c, {_jaccard('x', 'y')} AS uni, {_jaccard('sa', 'sb')} AS bi, {_MISSING('x', 'y')} AS added, {_MISSING('y', 'x')} AS removed FROM s)"""


# RE2 has no bounds above 1000 and no look-around, and the corpus needs neither.
def _rail_sql(x: str) -> str:
    """Names of rails, joined."""
    known = [(n, p.replace(rails.B, "\\b").replace("{1,20}", "{1,20}")) for n, p in rails.PATTERNS]
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{n}' END" for n, p in known) + "], lambda v: v IS NOT NULL)"


# ---- domains and URLs --------------------------------------------------------------------------------------------------
HOST = r"^[a-z]+://([^/:?#]+)"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, and each below suffixes of two labels and more."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("h"))
    return pages.select("page_id", F.explode(F.array("h", *(F.concat(F.lit("a."), F.regexp_replace("h", r"\.[a-z]+$", ""), F.lit(end)) for end in (".co.uk", ".s3.amazonaws.com", ".blob.core.windows.net", ".xyz")))).alias("host"))


HOSTS_SQL = f"""hosts AS (SELECT page_id, unnest([h, {', '.join(f"'a.' || regexp_replace(h, '\\.[a-z]+$', '') || '{end}'" for end in ('.co.uk', '.s3.amazonaws.com', '.blob.core.windows.net', '.xyz'))}]) AS host
    FROM (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS h FROM pages))"""


@query(f"WITH {HOSTS_SQL}, l AS (SELECT *, {_labels('host')} AS labels FROM hosts) SELECT page_id, host, {_domain('labels')} AS domain FROM l")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).select("page_id", "host", urls.registrable_domain(F.col("host")).alias("domain"))


URLS = ["https://bit.ly/a", "http://a.b.c.d.example.com/x", "https://secure-login.example.top/", "https://t.co/1", "https://my.wallet.example.co.uk", "https://x.linktr.ee/y"]


def some_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL and a few risky ones."""
    return table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in URLS], "url string"))


URLS_SQL = f"u AS (SELECT url FROM pages UNION ALL SELECT unnest([{', '.join(map(repr, URLS))}]))"
FLAGS_SQL = f"""{URLS_SQL}, h AS (SELECT url, regexp_extract(url, '{HOST}', 1) AS host FROM u), l AS (SELECT *, {_labels('host')} AS labels FROM h), d AS (SELECT *, {_domain('labels')} AS domain FROM l),
    f AS (SELECT url, host, domain, domain IN {_in(dims.SHORTENERS)} AS shortener, labels[-1] IN {_in(dims.SUSPICIOUS_TLDS)} AS suspicious_tld, labels[-1] AS tld,
        len(labels) - len(string_split(domain, '.')) >= 3 AS many_subdomains, regexp_matches(host, '{'|'.join(dims.TRUST_TOKENS)}') AS host_trust_token FROM d)"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs are parsed once; rows are joined back."""
    every = some_urls(spark, sf_dir)
    once = every.distinct().withColumn("parsed", F.get(urls.parse_urls(F.array("url")), F.lit(0)))
    return every.join(once.select("url", urls.url_risk(F.col("url"), F.col("parsed")).alias("risk")), "url")


@query(f"WITH {FLAGS_SQL} SELECT url, shortener, suspicious_tld, many_subdomains, host_trust_token FROM f")
def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).select("url", *(f"risk.{k}" for k in ("shortener", "suspicious_tld", "many_subdomains", "host_trust_token")))


@query(f"""WITH {FLAGS_SQL} SELECT url, host AS canonical_host,
    round(1 - exp(-(0.35 * shortener::INT + 0.4 * suspicious_tld::INT + 0.3 * many_subdomains::INT + 0.55 * host_trust_token::INT)), 6) AS score,
    array_to_string(list_filter([CASE WHEN shortener THEN 'URL shortener (' || domain || ') hides the destination' END, CASE WHEN suspicious_tld THEN 'high-abuse TLD (.' || tld || ')' END,
        CASE WHEN many_subdomains THEN 'unusually deep subdomain nesting' END, CASE WHEN host_trust_token THEN 'phishing-style trust word in the hostname' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM f""")
def url_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).select("url", F.col("risk.canonical_host").alias("canonical_host"), r6("risk.score").alias("score"), F.array_join("risk.reasons", "; ").alias("reasons"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
    q AS (SELECT page_id, u, regexp_extract(u, '^[a-z]+://([^/?]+)', 1) AS hostname, regexp_extract(u, '^[a-z]+://[^/?]+(/[^?]*)?', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS search, regexp_extract(u, '^[a-z]+', 0) AS scheme FROM p)
    SELECT page_id, scheme || '://' || hostname || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN search = '' THEN '' ELSE '?' || search END AS href, hostname,
        CASE WHEN path = '' THEN '/' ELSE path END AS pathname, search FROM q""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "pages").withColumn("c", F.get(urls.parse_urls(F.array("url")), F.lit(0))["canonical"])
    return parsed.select("page_id", "c.href", "c.hostname", "c.pathname", "c.search")


@query("""WITH n AS (SELECT doc_id, (doc_id * 65537 + 16909060) % 4294967296 AS n FROM documents),
    h AS (SELECT doc_id, n::VARCHAR AS host, n FROM n UNION ALL SELECT doc_id, '0x' || printf('%x', n) AS host, n FROM n)
    SELECT doc_id, host, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS address FROM h
    UNION ALL SELECT doc_id, q AS host, CASE WHEN list_max(list_transform(string_split(q, '.'), lambda x: x::INT)) < 256 THEN q END AS address
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[1-9][0-9]{0,2}\\.[1-9][0-9]{0,2}\\.[1-9][0-9]{0,2}\\.[1-9][0-9]{0,2}')) AS q FROM documents)""".replace("\\\\", "\\"))
def ipv4_disguise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.select("doc_id", ((F.col("doc_id") * 65537 + 16909060) % (1 << 32)).alias("n"))
    part = r"[1-9][0-9]{0,2}"
    quads = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\.".join([part] * 4)), 0)).alias("host"))
    every = n.select("doc_id", F.col("n").cast("string").alias("host")).unionByName(n.select("doc_id", F.concat(F.lit("0x"), F.lower(F.hex("n"))).alias("host"))).unionByName(quads)
    return every.select("doc_id", "host", urls.canonical_ipv4("host").alias("address"))


@query(f"""WITH {HOSTS_SQL} SELECT DISTINCT host, CASE host WHEN 'xn--pypal-4ve.com' THEN 'pаypal.com' WHEN 'xn--mnchen-3ya.de' THEN 'münchen.de' WHEN 'xn--bcher-kva.example' THEN 'bücher.example' WHEN 'xn--fsqu00a.xn--0zwm56d' THEN '例子.测试' ELSE host END AS decoded
    FROM (SELECT host FROM hosts UNION ALL SELECT unnest(['xn--pypal-4ve.com', 'xn--mnchen-3ya.de', 'xn--!!.org', 'xn--bcher-kva.example', 'xn--fsqu00a.xn--0zwm56d']))""")
def punycode_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded hosts of pages and of spoofed ones, whose decodings the SQL states."""
    odd = [("xn--pypal-4ve.com",), ("xn--mnchen-3ya.de",), ("xn--!!.org",), ("xn--bcher-kva.example",), ("xn--fsqu00a.xn--0zwm56d",)]
    every = hosts(spark, sf_dir).select("host").unionByName(spark.createDataFrame(odd, "host string")).distinct()
    return every.select("host", F.get(urls.decode_hosts(F.array("host")), F.lit(0)).alias("decoded"))


# ---- look-alikes -------------------------------------------------------------------------------------------------------
NAMES_SQL = f"""names AS (SELECT DISTINCT label FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS label FROM part UNION ALL SELECT lower(s_name) AS label FROM supplier
    UNION ALL SELECT unnest([{', '.join(repr(x) for b, _ in dims.BRANDS for x in (b, b.replace('a', '4'), b + '-login', b[:-1], b[1] + b[0] + b[2:], b.replace('m', 'rn')))}]) AS label)),
    skeletons AS (SELECT label, label || '.net' AS domain, translate(replace(replace(replace(lower(label), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '{''.join(dims.LEET)}', '{''.join(dims.LEET.values())}') AS skeleton FROM names),
    brands AS (SELECT unnest(range({len(dims.BRANDS)})) AS ord, unnest([{', '.join(repr(b) for b, _ in dims.BRANDS)}]) AS brand, unnest([{', '.join(repr(d) for _, d in dims.BRANDS)}]) AS brand_domain)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, supplier names, and the brands with one change each."""
    changed = [(x,) for b, _ in dims.BRANDS for x in (b, b.replace("a", "4"), b + "-login", b[:-1], b[1] + b[0] + b[2:], b.replace("m", "rn"))]
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("label")).unionByName(table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("label")))
    once = words.unionByName(spark.createDataFrame(changed, "label string")).distinct()
    return once.select("label", F.concat("label", F.lit(".net")).alias("domain"), lookalike.deglyph(F.col("label")).alias("skeleton"))


def brand_table(spark: SparkSession) -> DataFrame:
    """47 fixed rows, so always small enough to send."""
    return F.broadcast(dims.brands(spark).select("ord", F.col("label").alias("brand"), F.col("domain").alias("brand_domain")))


@query(f"WITH {NAMES_SQL} SELECT label, skeleton FROM skeletons")
def brand_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("label", "skeleton")


@query(f"WITH {NAMES_SQL} SELECT label, brand FROM skeletons JOIN brands ON skeleton = brand AND domain <> brand_domain")
def lookalike_homoglyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).join(brand_table(spark), (F.col("skeleton") == F.col("brand")) & (F.col("domain") != F.col("brand_domain"))).select("label", "brand")


_INSIDE = "domain <> brand_domain AND length(brand) >= 4 AND length(skeleton) > length(brand) AND length(skeleton) <= length(brand) + 14 AND contains(skeleton, brand)"


@query(f"WITH {NAMES_SQL} SELECT label, arg_min(brand, ord) AS brand FROM skeletons JOIN brands ON {_INSIDE} GROUP BY label")
def lookalike_combosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).join(brand_table(spark), F.expr(_INSIDE)).groupBy("label").agg(F.min_by("brand", "ord").alias("brand"))


_NEAR = "domain <> brand_domain AND length(brand) >= 4 AND abs(length(brand) - length(skeleton)) <= 2"


@query(f"WITH {NAMES_SQL} SELECT label, brand, damerau_levenshtein(skeleton, brand)::INT AS distance FROM skeletons JOIN brands ON {_NEAR} AND damerau_levenshtein(skeleton, brand) = 1")
def lookalike_near_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = names(spark, sf_dir).join(brand_table(spark), F.expr(_NEAR)).withColumn("distance", lookalike.osa_distance("skeleton", "brand"))
    return near.filter("distance = 1").select("label", "brand", "distance")


@query(f"""WITH {NAMES_SQL}, j AS (SELECT label, brand, brand_domain, ord, domain, skeleton, length(brand) AS n, damerau_levenshtein(skeleton, brand) AS d FROM skeletons JOIN brands ON domain <> brand_domain),
    k AS (SELECT label, brand, ord, CASE WHEN skeleton = brand THEN 0 WHEN {_INSIDE} THEN 1 WHEN n >= 4 AND abs(n - length(skeleton)) <= 2 AND d = 1 THEN 2 WHEN n >= 8 AND abs(n - length(skeleton)) <= 2 AND d = 2 THEN 3 END AS kind FROM j)
    SELECT label, arg_min(brand, kind * 100 + ord) AS brand, list_extract(['homoglyph', 'combosquat', 'near-edit', 'near-edit'], min(kind)::INT + 1) AS kind,
        list_extract(['high', 'high', 'high', 'medium'], min(kind)::INT + 1) AS severity FROM k WHERE kind IS NOT NULL GROUP BY label""")
def lookalike_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.match(names(spark, sf_dir), dims.brands(spark)).select("label", "brand", "kind", "severity")


# ---- characters --------------------------------------------------------------------------------------------------------
@query(f"WITH {VERSIONS_SQL} SELECT doc_id, md5(regexp_replace(c, '[{chars.INVISIBLE}]', '', 'g')) AS stripped FROM e")
def strip_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", F.md5(chars.strip_invisible("c")).alias("stripped"))


@query(f"WITH {VERSIONS_SQL} SELECT doc_id, md5({_MATCH('c')}) AS matched FROM e")
def normalize_for_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", F.md5(pairs.matched(F.col("c"))).alias("matched"))


@query(f"""WITH {VERSIONS_SQL} SELECT doc_id, regexp_matches(c, '[{chars.INVISIBLE}]') AS invisible, regexp_matches(c, '[{chars.BIDI}]') AS bidi, regexp_matches(c, '{chars.CONFUSABLE}') AS confusable FROM e""")
def hidden_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", chars.contains_invisible("c").alias("invisible"), chars.contains_bidi("c").alias("bidi"), chars.contains_confusable("c").alias("confusable"))


@query(f"""WITH {VERSIONS_SQL}, m AS (SELECT doc_id, unnest(string_split(c, ' ')) AS token FROM e)
    SELECT doc_id, token, 'Cyrillic' AS script FROM m WHERE regexp_matches(token, '[{chars.LATIN}]') AND regexp_matches(token, '[{chars.SCRIPTS['Cyrillic']}]')""")
def mixed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = versions(spark, sf_dir).select("doc_id", F.explode(F.split(chars.nfkc("c"), " ")).alias("token"))
    return tokens.withColumn("script", chars.script_mix("token")).filter("script <> ''")


# ---- links -------------------------------------------------------------------------------------------------------------
_BARE, _WWW = r"https?://[^\s<>()\]\x22\x27]+", r"\bwww\.[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})+(?:/[^\s<>()\]\x22\x27]*)?"
_CLEAN = r"""lambda x: regexp_replace(x, '[).,!?;:\x22\x27]+$', '')"""
LINKS_SQL = rf"""{VERSIONS_SQL}, k AS (SELECT doc_id, t, c, list_concat(regexp_extract_all(c, '\]\((https?://[^)\s>]+)', 1), regexp_extract_all(c, '\]\((javascript:[^)\s]*)\)', 1), regexp_extract_all(c, '{_BARE}'),
    list_transform(regexp_extract_all(c, '{_WWW}'), lambda x: 'https://' || x)) AS every FROM e), links AS (SELECT doc_id, t, c, list_sort(list_distinct(list_transform(every, {_CLEAN}))) AS hrefs FROM k)"""


@query(rf"WITH {VERSIONS_SQL} SELECT doc_id, array_to_string(regexp_extract_all(c, '{_BARE}'), ' ') AS bare, array_to_string(regexp_extract_all(c, '{_WWW}'), ' ') AS www, array_to_string(regexp_extract_all(c, '\[([^\]]*)\]\((https?://[^)\s>]+)[^)]*\)', 1), ' ') AS labels FROM e")
def link_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda p, n: F.array_join(F.regexp_extract_all("c", F.lit(p), n), " ")
    return versions(spark, sf_dir).select("doc_id", found(links.BARE, 0).alias("bare"), found(links.BARE_WWW, 0).alias("www"), found(links.MARKDOWN, 1).alias("labels"))


@query(f"WITH {LINKS_SQL} SELECT doc_id, array_to_string(hrefs, ' ') AS hrefs FROM links")
def link_extract_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(links.extract_links(F.col("c"))), " ").alias("hrefs"))


@query(rf"""WITH {VERSIONS_SQL}, m AS (SELECT doc_id, regexp_extract(c, '\[([^\]]*)\]\(https?://([^/)\s]+)', 1) AS label, regexp_extract(c, '\[([^\]]*)\]\((https?://[^)\s]+)', 2) AS href, regexp_extract(c, '\[([^\]]*)\]\(https?://([^/)\s]+)', 2) AS host FROM e),
    d AS (SELECT doc_id, href, {_labels("regexp_extract(label, '[a-z0-9-]+(\\.[a-z0-9-]+)+', 0)")} AS shown, {_labels('host')} AS goes FROM m WHERE label <> '')
    SELECT doc_id, href FROM d WHERE len(shown) > 0 AND {_domain('shown')} <> {_domain('goes')}""")
def cloaked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir).select("doc_id", links.extract_link_refs(F.col("c")).alias("refs")).filter(F.size("refs") > 0)
    found = found.withColumns({"labels": links.label_forms(F.col("refs")), "parsed": urls.parse_urls(F.transform("refs", lambda r: r["href"]))})
    found = found.select("doc_id", F.inline(F.arrays_zip(F.transform("refs", lambda r: r["href"]).alias("href"), F.col("labels").alias("label"), F.transform("parsed", lambda p: p["host"]).alias("host"))))
    return found.filter(links.cloaked(F.col("label"), F.col("host"))).select("doc_id", "href")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' paypal[.]com' WHEN 1 THEN ' paypal (dot) com' WHEN 2 THEN ' hxxps://evil.ru' WHEN 3 THEN ' paypal dot com' ELSE ' paypal . com' END AS x FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\bhxxps\b', 'https', 'gi'), '[\[({]\s*\.\s*[\])}]', '.', 'g'), '([a-zA-Z0-9])\s+\.\s+([a-zA-Z0-9])', '\1.\2', 'g'),
        '([a-zA-Z0-9])\s*\(\s*dot\s*\)\s*([a-zA-Z0-9])', '\1.\2', 'gi'), '([a-zA-Z0-9])\s+dot\s+([a-zA-Z0-9])', '\1.\2', 'gi')) AS defanged FROM d""")
def defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("CASE doc_id % 5 WHEN 0 THEN ' paypal[.]com' WHEN 1 THEN ' paypal (dot) com' WHEN 2 THEN ' hxxps://evil.ru' WHEN 3 THEN ' paypal dot com' ELSE ' paypal . com' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(links.defang(F.concat(F.coalesce("text", F.lit("")), end))).alias("defanged"))


# What each kind of edit adds: links, domains, dangerous ones, risk, look-alike, cloaked.
_NEW = {1: ("https://bit.ly/sketchy-shop", "bit.ly"), 2: ("https://shop.fresh-example.net/deal?id=1", "fresh-example.net"), 3: ("https://evil.ru/login", "evil.ru"), 4: ("javascript:run", ""), 7: ("https://pаypal.com/x", "xn--pypal-4ve.com"), 9: ("http://www.paypal-secure.com/login", "paypal-secure.com")}


@query(f"""WITH {LINKS_SQL} SELECT doc_id, array_to_string(list_filter(hrefs, lambda x: NOT list_contains(before, x)), ' ') AS added
    FROM (SELECT doc_id, hrefs, CASE WHEN doc_id % 24 >= 12 THEN ['https://bit.ly/sketchy-shop'] ELSE []::VARCHAR[] END AS before FROM links)""")
def added_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("doc_id") % 24 >= 12, F.array(F.lit("https://bit.ly/sketchy-shop"))).otherwise(F.array().cast("array<string>"))
    return versions(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(links.new_items(before, links.extract_links(F.col("c")))), " ").alias("added"))


@query("WITH " + LINKS_SQL + " SELECT doc_id, len(hrefs) AS n_links, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{d}'" for k, (_, d) in _NEW.items()) + " ELSE '' END AS domains FROM links")
def added_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir).select("doc_id", links.extract_links(F.col("c")).alias("after"))
    return found.select("doc_id", "after", urls.parse_urls("after").alias("parsed")).select("doc_id", F.size("after").cast("long").alias("n_links"), F.array_join(links.domains_of(F.col("parsed")), " ").alias("domains"))


@query(f"WITH {VERSIONS_SQL} SELECT doc_id, array_to_string({_rail_sql(_STRIP('c'))}, ',') AS now, array_to_string({_rail_sql(_STRIP('t'))}, ',') AS before FROM e")
def solicitation_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir).select("doc_id", pairs.rails_in(F.col("t"), F.col("c")).alias("r"))
    return found.select("doc_id", F.array_join("r.rails_after", ",").alias("now"), F.array_join("r.rails_before", ",").alias("before"))


# ---- similarity and score ----------------------------------------------------------------------------------------------
def jaccards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", pairs.jaccard(F.col("t"), F.col("c")).alias("j"))


@query(f"WITH {PROFILE} SELECT doc_id, round(uni, 6) AS jaccard FROM p")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccards(spark, sf_dir).select("doc_id", r6("j.tokens").alias("jaccard"))


@query(f"WITH {PROFILE} SELECT doc_id, round(bi, 6) AS jaccard FROM p")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccards(spark, sf_dir).select("doc_id", r6("j.bigrams").alias("jaccard"))


@query(f"WITH {PROFILE} SELECT doc_id, round(0.5 * uni + 0.5 * bi, 6) AS similarity, round(1 - (0.5 * uni + 0.5 * bi), 6) AS content_change, round(added, 6) AS added_fraction, round(removed, 6) AS removed_fraction FROM p")
def change_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir).select("doc_id", pairs.change_profile(F.col("t"), F.col("c")).alias("p"))
    return found.select("doc_id", r6("p.similarity").alias("similarity"), r6(1 - F.col("p.similarity")).alias("content_change"), r6("p.added_fraction").alias("added_fraction"), r6("p.removed_fraction").alias("removed_fraction"))


_CLAMP = lambda x: f"greatest(0.0, least(1.0, {x}))"
_OBFUSCATION = f"""1 - (1 - CASE WHEN regexp_matches(c, '[{chars.INVISIBLE}]') AND NOT regexp_matches(t, '[{chars.INVISIBLE}]') THEN 0.4 ELSE 0.0 END) * (1 - CASE WHEN regexp_matches(c, '[{chars.BIDI}]') AND NOT regexp_matches(t, '[{chars.BIDI}]') THEN 0.75 ELSE 0.0 END)
    * (1 - CASE WHEN regexp_matches(c, '{chars.CONFUSABLE}') AND NOT regexp_matches(t, '{chars.CONFUSABLE}') THEN 0.5 ELSE 0.0 END)"""
_N_RAILS = f"len(list_filter({_rail_sql(_STRIP('c'))}, lambda x: NOT list_contains({_rail_sql(_STRIP('t'))}, x)))"
# By kind of edit: base, then 1 minus each of risk, look-alike (0.9), cloaking (0.85) and danger (0.95).
_LINK = """CASE doc_id % 12 WHEN 1 THEN 1 - 0.25 * exp(-0.35) WHEN 2 THEN 0.75 WHEN 3 THEN 1 - 0.25 * 0.15 WHEN 4 THEN 1 - 0.4 * 0.05
    WHEN 7 THEN 1 - 0.25 * exp(-(0.6 + 0.7 + 0.85)) * 0.1 WHEN 9 THEN 1 - 0.25 * exp(-0.55) * 0.1 ELSE 0.0 END"""
SCORES_SQL = f"""{PROFILE}, n AS (SELECT *, 1 - (0.5 * uni + 0.5 * bi) AS net, {_LINK} AS link, {_OBFUSCATION} AS obfuscation, {_N_RAILS} AS n_rails FROM p),
    g AS (SELECT *, CASE WHEN n_rails > 0 THEN 1 - exp(-0.5 * n_rails) ELSE 0.0 END AS solicitation,
        1 - (1 - CASE WHEN net > 0.4 THEN 0.4 * {_CLAMP('(net - 0.4) / 0.6')} ELSE 0.0 END) * (1 - CASE WHEN added > 0.5 THEN 0.3 * {_CLAMP('(added - 0.5) / 0.5')} ELSE 0.0 END) * (1 - CASE WHEN doc_id > 120 THEN 0.2 ELSE 0.0 END) AS structural FROM n),
    z AS (SELECT *, 1 - (1 - link) * (1 - solicitation) * (1 - obfuscation) * (1 - structural) AS score FROM g)"""
_BAND = "CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.55 THEN 'medium' WHEN score >= 0.30 THEN 'low' ELSE 'none' END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_drift(edits(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT doc_id, round(link, 6) AS link, round(solicitation, 6) AS solicitation, round(obfuscation, 6) AS obfuscation, round(structural, 6) AS structural FROM z")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", *(r6(c).alias(c) for c in ("link", "solicitation", "obfuscation", "structural")))


@query(f"WITH {SCORES_SQL} SELECT doc_id, round(score, 6) AS score, {_BAND} AS band FROM z")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", r6("score").alias("score"), "band")


@query(f"WITH {SCORES_SQL} SELECT {_BAND} AS band, count(*) AS n, round(avg(score), 6) AS mean_score FROM z GROUP BY 1")
def drift_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


@query(f"WITH {SCORES_SQL} SELECT CASE WHEN score >= 0.55 THEN 'requeue' ELSE 'none' END AS action, {_BAND} AS band, count(*) AS n FROM z GROUP BY ALL")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("score") >= Settings().threshold, Settings().action).otherwise("none")
    return scored(spark, sf_dir).groupBy(action.alias("action"), "band").agg(F.count("*").alias("n"))


_SAID = {
    1: ["new link added after approval: https://bit.ly/sketchy-shop", "new destination domain not in approved version: bit.ly", "risky new link — URL shortener (bit.ly) hides the destination"],
    2: ["new link added after approval: https://shop.fresh-example.net/deal?id=1", "new destination domain not in approved version: fresh-example.net"],
    3: ["new link added after approval: https://evil.ru/login", "new destination domain not in approved version: evil.ru", "cloaked link: the visible text shows a different domain than where it goes (https://evil.ru/login)"],
    4: ["new link added after approval: javascript:run", "dangerous URL scheme used: javascript:"], 5: ["hidden/invisible characters added after approval", "bidi/Trojan-Source control characters added after approval"], 6: ["hidden/invisible characters added after approval"],
    7: ["new link added after approval: https://pаypal.com/x", "new destination domain not in approved version: xn--pypal-4ve.com", "risky new link — punycode host (possible homograph domain)", "brand look-alike: domain 'pаypal' is a visual look-alike of 'paypal' (paypal.com)", "homoglyph (look-alike) characters added after approval"],
    8: ["new off-platform solicitation: telegram, off-platform-dm"], 9: ["new link added after approval: http://www.paypal-secure.com/login", "new destination domain not in approved version: paypal-secure.com", "risky new link — phishing-style trust word in the hostname", "brand look-alike: combosquat: 'paypal-secure' wraps the brand 'paypal'"],
}
_SQL_TEXT = lambda s: "'" + s.replace("'", "''") + "'"


@query(f"""WITH {SCORES_SQL} SELECT doc_id, array_to_string(list_concat(CASE doc_id % 12 {' '.join(f"WHEN {k} THEN [{', '.join(map(_SQL_TEXT, v))}]" for k, v in _SAID.items())} ELSE []::VARCHAR[] END,
    list_filter([CASE WHEN net > 0.4 THEN 'body substantially rewritten (' || floor(net * 100 + 0.5)::INT || '% net change)' END, CASE WHEN added > 0.5 THEN floor(added * 100 + 0.5)::INT || '% of current text was added after approval' END,
        CASE WHEN doc_id > 120 THEN 'edited ~' || floor(doc_id / 60.0 + 0.5)::INT || 'h after approval' END], lambda x: x IS NOT NULL)), ' | ') AS signals FROM z""")
def drift_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.array_join("signals", " | ").alias("signals"))


# ---- approvals, edits, log ---------------------------------------------------------------------------------------------
TTL = 3.0
EVENTS_SQL = "a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')"
_LIVE = f"epoch_us(edited_at) < epoch_us(approved_at) + {int(TTL * 86400_000_000)}"
ASOF_SQL = f"{EVENTS_SQL}, j AS (SELECT b.event_id, b.user_id, b.value, b.ts AS edited_at, a.event_id AS approval_id, a.ts AS approved_at FROM b ASOF JOIN a ON b.user_id = a.user_id AND b.ts >= a.ts)"


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups stand for approvals of the user's thing."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.lit("c").alias("community_id"), F.col("user_id").cast("string").alias("thing_id"), F.col("ts").cast("timestamp").alias("approved_at"), F.col("event_id").alias("approval_id"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand for edits."""
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.lit("c").alias("community_id"), F.col("user_id").cast("string").alias("thing_id"), F.col("ts").cast("timestamp").alias("edited_at"), "event_id", "value")


def joined(spark: SparkSession, sf_dir: str, ttl: float = TTL) -> DataFrame:
    return watch.as_of(clicks(spark, sf_dir), approvals(spark, sf_dir), ttl)


@query(f"WITH {ASOF_SQL} SELECT event_id, approval_id, strftime(approved_at, '%Y-%m-%d %H:%M:%S.%f') AS approved FROM j")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir, 10_000).select("event_id", "approval_id", F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("approved"))


_TTL_SQL = f"WITH {ASOF_SQL} SELECT event_id, approval_id FROM j WHERE {_LIVE}"


@query(_TTL_SQL)
def asof_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("event_id", "approval_id")


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream gives for the events in the order of their arrival, up to a day late, over five runs on one checkpoint."""
    from driftlens.streaming.replay import replay

    both = stateful.encode(approvals(spark, sf_dir), "approval", "approved_at").unionByName(stateful.encode(clicks(spark, sf_dir), "edit", "edited_at"))
    return replay(both, TTL, NOW)[0]


@query(_TTL_SQL)
def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream in which events come late and out of order."""
    out = stateful.joined(carried(spark, sf_dir))
    return out.select(F.get_json_object("edit", "$.event_id").cast("long").alias("event_id"), F.get_json_object("approval", "$.approval_id").cast("long").alias("approval_id"))


@query(f"""SELECT thing_id, approval_id, strftime(ends, '%Y-%m-%d %H:%M:%S.%f') AS expired FROM (
    SELECT user_id::VARCHAR AS thing_id, event_id AS approval_id, ts + INTERVAL 3 DAY AS ends, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events WHERE event_type = 'signup')
    WHERE ends <= TIMESTAMP '{NOW}' AND (later IS NULL OR later >= ends)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs out on the same stream, told by the state's timers."""
    out = stateful.expired(carried(spark, sf_dir))
    return out.select("thing_id", F.get_json_object("approval", "$.approval_id").cast("long").alias("approval_id"), F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expired"))


@query(f"WITH {ASOF_SQL} SELECT event_id, round((epoch_us(edited_at) - epoch_us(approved_at)) / 6e7, 6) AS minutes, (epoch_us(edited_at) - epoch_us(approved_at)) / 6e7 > 24 * 60 AS late FROM j WHERE {_LIVE}")
def late_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("event_id", r6("minutes_since_approval").alias("minutes"), (F.col("minutes_since_approval") > 24 * 60).alias("late"))


_NOW = f"TIMESTAMP '{NOW}'"
_LATEST_SQL = "SELECT user_id::VARCHAR AS thing_id, max(ts) AS approved_at FROM events WHERE event_type = 'signup' GROUP BY user_id"


@query(f"SELECT count(*) AS watching_indexed, count(*) FILTER (approved_at > {_NOW} - INTERVAL 3 DAY) AS watching_live FROM ({_LATEST_SQL})")
def watched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = watch.watch_list(approvals(spark, sf_dir))
    return watched.agg(F.count("*").alias("watching_indexed"), F.count_if(F.unix_micros("approved_at") > F.unix_micros(F.lit(str(NOW)).cast("timestamp")) - int(TTL * 86400_000_000)).alias("watching_live"))


@query(f"SELECT thing_id, strftime(approved_at, '%Y-%m-%d %H:%M:%S.%f') AS approved FROM ({_LATEST_SQL}) WHERE approved_at > {_NOW} - INTERVAL 3 DAY")
def prune_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.prune(watch.watch_list(approvals(spark, sf_dir)), F.lit(str(NOW)).cast("timestamp"), TTL).select("thing_id", F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("approved"))


@query("SELECT user_id::VARCHAR AS thing_id, arg_max(event_id, ts) AS approval_id FROM events WHERE event_type = 'signup' GROUP BY user_id")
def latest_per_thing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.snapshots(approvals(spark, sf_dir)).select("thing_id", "approval_id")


# A log of edits: score from the click's value, the thing is the user.
_SCORE = "least(1.0, abs(value) / 20.0)"
LOG_SQL = f"""{ASOF_SQL}, s AS (SELECT user_id::VARCHAR AS thing_id, floor({_SCORE} * 100 + 0.5) / 100 AS score, edited_at AS detected_at, event_id FROM j WHERE {_LIVE} AND {_SCORE} >= 0.55),
    l AS (SELECT thing_id, max(detected_at) AS detected_at, arg_max(score, detected_at) AS score, arg_max(event_id, detected_at) AS event_id FROM s GROUP BY thing_id), k AS (SELECT *, row_number() OVER (ORDER BY detected_at DESC, thing_id) AS rank FROM l)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = joined(spark, sf_dir).withColumn("score", F.expr(_SCORE.replace("1.0", "1.0D").replace("20.0", "20.0D"))).filter(F.col("score") >= Settings().threshold)
    rows = hits.select("community_id", "thing_id", log.two_places(F.col("score")).alias("score"), F.col("edited_at").alias("detected_at"), "event_id", F.lit("post").alias("type"), F.lit("requeue").alias("action"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("signals"))
    return log.latest_per_thing(rows)


@query(f"WITH {LOG_SQL} SELECT thing_id, event_id, score, rank FROM k WHERE rank <= 200")
def drift_log_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.retain(event_log(spark, sf_dir)).select("thing_id", "event_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LOG_SQL}, n AS (SELECT least(60, count(*)) AS n FROM k) SELECT thing_id, rank, true AS has_prev, n > 6 AS has_next, greatest(1, ceil(n / 3.0))::INT AS pages FROM k, n WHERE rank BETWEEN 4 AND 6 AND rank <= 60")
def drift_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.page(event_log(spark, sf_dir), 1).select("thing_id", F.col("rank").cast("long").alias("rank"), "has_prev", "has_next", "pages")


_AGE = f"greatest(0, floor((epoch_us({_NOW}) - epoch_us(detected_at)) / 1e6)::BIGINT)"


@query(f"""WITH {LOG_SQL}, x AS (SELECT *, {_AGE} AS s FROM k) SELECT thing_id, 'POST' AS badge, printf('drift %.2f', score) AS score_text, CASE WHEN score >= 0.8 THEN '#ff5c5c' WHEN score >= 0.5 THEN '#ffae42' ELSE '#9aa6ab' END AS colour,
    CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age, 'removed & re-queued' AS action_label, 'a b c' AS shown FROM x""")
def log_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.render(event_log(spark, sf_dir), F.lit(str(NOW)).cast("timestamp")).select("thing_id", "badge", "score_text", "colour", "age", "action_label", F.array_join("shown_signals", " ").alias("shown"))


@query(f"WITH {VERSIONS_SQL} SELECT doc_id, md5(substr(t, 1, 300)) AS before_excerpt, md5(substr(c, 1, 300)) AS after_excerpt FROM e")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", *(F.md5(F.substring(c, 1, log.EXCERPT)).alias(name) for c, name in (("t", "before_excerpt"), ("c", "after_excerpt"))))


@query(f"WITH {LOG_SQL} SELECT strftime(detected_at, '%Y-%m-%d') AS day, CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END AS band, count(*) AS n FROM k GROUP BY ROLLUP (day, band)")
def drift_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts by day and band with subtotals."""
    rows = event_log(spark, sf_dir).select(F.date_format("detected_at", "yyyy-MM-dd").alias("day"), F.when(F.col("score") >= 0.85, "high").otherwise("medium").alias("band"))
    return rows.rollup("day", "band").agg(F.count("*").alias("n"))


@query("""SELECT 'c' || n_nationkey AS community_id, 'Driftlens watches approved content for later edits in c' || n_nationkey AS message FROM nation
    WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING sum(s_acctbal) > 15000)""")
def welcome_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations install; those whose suppliers hold much have been welcomed before."""
    installs = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("community_id"))
    rich = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("held")).filter("held > 15000")
    return watch.welcome(installs, rich.select(F.concat(F.lit("c"), "s_nationkey").alias("community_id")), "Driftlens")
