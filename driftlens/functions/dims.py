"""Fixed values that results depend on, and the dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public suffixes of several labels, of registries and of hosts that let anyone register below them.
ICANN_SUFFIXES = """
co.uk org.uk gov.uk ac.uk me.uk ltd.uk plc.uk net.uk nhs.uk police.uk sch.uk mod.uk
com.au net.au org.au edu.au gov.au id.au asn.au
co.nz net.nz org.nz govt.nz ac.nz school.nz geek.nz kiwi.nz
co.za org.za gov.za ac.za edu.za net.za web.za
co.in net.in org.in gen.in firm.in ind.in ac.in edu.in gov.in nic.in
com.br net.br org.br gov.br edu.br
co.jp or.jp ne.jp ac.jp go.jp ad.jp gr.jp ed.jp lg.jp
com.cn net.cn org.cn gov.cn edu.cn ac.cn
com.hk net.hk org.hk edu.hk gov.hk
com.tw net.tw org.tw edu.tw gov.tw
co.kr or.kr go.kr ne.kr ac.kr pe.kr re.kr
com.sg com.my com.tr com.ar com.ua com.pl com.mx com.ve com.ec
com.co com.pe com.vn com.ph com.eg com.sa com.kw com.bh com.qa
co.il co.id or.id ac.id net.id co.ke co.th or.th in.th
edu.sg gov.sg net.sg org.sg
""".split()
PRIVATE_SUFFIXES = """
github.io githubusercontent.com gitlab.io bitbucket.io
s3.amazonaws.com compute.amazonaws.com elasticbeanstalk.com cloudfront.net execute-api.amazonaws.com
azurewebsites.net cloudapp.net azureedge.net blob.core.windows.net
appspot.com firebaseapp.com web.app run.app cloudfunctions.net
workers.dev pages.dev r2.dev
vercel.app now.sh netlify.app netlify.com
herokuapp.com herokussl.com
blogspot.com tumblr.com wordpress.com weebly.com wixsite.com
000webhostapp.com neocities.org glitch.me repl.co replit.dev
fly.dev render.com ngrok.io ngrok-free.app trycloudflare.com
surge.sh gh-pages.io readthedocs.io discordapp.net discord.media
""".split()
SUFFIXES = ICANN_SUFFIXES + PRIVATE_SUFFIXES

# Link shorteners and link-in-bio hosts, often abused top-level domains, words that feign trust.
SHORTENERS = """
bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly adf.ly bit.do cutt.ly rebrand.ly rb.gy shorturl.at tiny.cc t.ly
lnkd.in db.tt qr.ae v.gd shorte.st soo.gd clck.ru trib.al linktr.ee linktree.com beacons.ai bio.link linkin.bio
""".split()
SUSPICIOUS_TLDS = """
zip mov top xyz gq tk ml cf ga work click link country kim loan download review stream racing win bid date rest fit
cam monster quest sbs cfd
""".split()
TRUST_TOKENS = "secure login signin verify account update confirm webscr banking wallet unlock suspend support".split()

# Weights of a URL's risks, and the score categories.
RISK_WEIGHTS = {
    "shortener": 0.35, "ip_host": 0.6, "punycode": 0.6, "credentials": 0.6, "suspicious_tld": 0.4, "many_subdomains": 0.3,
    "confusable_host": 0.7, "mixed_script_host": 0.85, "host_trust_token": 0.55, "dangerous_scheme": 0.95, "double_encoded": 0.5, "userinfo_domain": 0.7,
}

# Tracked brands and their own domains, in order.
BRANDS = [
    ("google", "google.com"), ("microsoft", "microsoft.com"), ("apple", "apple.com"), ("amazon", "amazon.com"), ("facebook", "facebook.com"),
    ("instagram", "instagram.com"), ("whatsapp", "whatsapp.com"), ("meta", "meta.com"), ("netflix", "netflix.com"), ("spotify", "spotify.com"),
    ("adobe", "adobe.com"), ("dropbox", "dropbox.com"), ("linkedin", "linkedin.com"), ("yahoo", "yahoo.com"), ("twitter", "twitter.com"),
    ("paypal", "paypal.com"), ("stripe", "stripe.com"), ("venmo", "venmo.com"), ("cashapp", "cash.app"), ("wise", "wise.com"), ("zelle", "zellepay.com"),
    ("chase", "chase.com"), ("wellsfargo", "wellsfargo.com"), ("bankofamerica", "bankofamerica.com"), ("citibank", "citibank.com"), ("capitalone", "capitalone.com"), ("amex", "americanexpress.com"),
    ("coinbase", "coinbase.com"), ("binance", "binance.com"), ("kraken", "kraken.com"), ("metamask", "metamask.io"), ("ledger", "ledger.com"), ("trezor", "trezor.io"), ("blockchain", "blockchain.com"),
    ("steam", "steampowered.com"), ("steamcommunity", "steamcommunity.com"), ("discord", "discord.com"), ("epicgames", "epicgames.com"), ("roblox", "roblox.com"), ("twitch", "twitch.tv"), ("riotgames", "riotgames.com"),
    ("ups", "ups.com"), ("fedex", "fedex.com"), ("usps", "usps.com"), ("dhl", "dhl.com"), ("reddit", "reddit.com"), ("redditmail", "redditmail.com"),
]

# Characters that look like Latin ones, each with what it is folded to.
CONFUSABLES = dict(pair.split("=") for pair in """
а=a б=b в=b г=r д=d е=e ё=e з=3 и=n й=n к=k л=n м=m н=h о=o п=n р=p с=c т=t у=y х=x ц=u ч=y ь=b ы=bl
А=a В=b Е=e К=k М=m Н=h О=o Р=p С=c Т=t У=y Х=x
ѕ=s і=i ј=j ԁ=d ѵ=v ѡ=w Ѕ=s І=i Ј=j Ԁ=d
α=a β=b γ=y ε=e ζ=z η=n θ=o ι=i κ=k ν=v ο=o π=n ρ=p σ=o τ=t υ=u φ=o χ=x ψ=w ω=w
Α=a Β=b Ε=e Ζ=z Η=h Ι=i Κ=k Μ=m Ν=n Ο=o Ρ=p Τ=t Υ=y Χ=x
օ=o ս=u ա=w հ=h ո=n
Ꭺ=a Ꭼ=e Ꭿ=i Ꮃ=w Ꮅ=l Ꮇ=m Ꮎ=n Ꮕ=o
ɑ=a ɡ=g ɪ=i ɴ=n ʀ=r ʟ=l ɢ=g ʙ=b ʜ=h ᴋ=k ᴍ=m ᴘ=p ᴛ=t ᴜ=u
ı=i ȷ=j
。=. ．=. ｡=. ／=/ ⁄=/ ∕=/
""".split())

# Characters of digits and signs that stand for letters, and letter pairs that look like one letter.
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
DIGRAPHS = [("rn", "m"), ("vv", "w"), ("cl", "d")]


def brand_array() -> Column:
    """The brands as an array of (ord, label, domain) for use inside a row; no brand's skeleton differs from its label."""
    return F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.lit(domain).alias("domain")) for i, (label, domain) in enumerate(BRANDS)))


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BRANDS)], "ord int, label string, domain string")


def suffixes(spark: SparkSession) -> DataFrame:
    """The union of both suffix lists, once each."""
    rows = lambda names, kind: [(s, kind) for s in names]
    return spark.createDataFrame(rows(ICANN_SUFFIXES, "icann") + rows(PRIVATE_SUFFIXES, "private"), "suffix string, kind string").distinct()
