"""URL operators: parts, redaction, query pairs, the public address policy, and what a fetched page really is."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, port, path, query and fragment by one pattern; absent parts are empty."""
    g = lambda i: F.regexp_extract(url, _URL, i)
    authority = F.regexp_replace(g(2), r"^.*@", "")
    return {
        "scheme": F.lower(g(1)),
        "host": F.lower(F.regexp_replace(authority, r":[0-9]*$", "")),
        "port": F.regexp_extract(authority, r":([0-9]+)$", 1),
        "path": g(3),
        "query": F.regexp_replace(g(4), r"^\?", ""),
        "fragment": F.regexp_replace(g(5), r"^#", ""),
    }


def redacted(url: Column) -> Column:
    """A URL to show: without user information, query and fragment."""
    p = parts(url)
    port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")
    return F.concat(p["scheme"], F.lit("://"), p["host"], port, p["path"])


def query_pairs(rows: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, ord, name, value) of each query parameter."""
    pieces = F.split(parts(F.col(url))["query"], "&")
    found = rows.select(key, F.posexplode(pieces).alias("ord", "_p")).where("_p <> ''")
    value = F.when(F.col("_p").contains("="), F.regexp_replace("_p", r"^[^=]*=", "")).otherwise("")
    return found.select(key, F.col("ord").cast("long").alias("ord"), F.regexp_replace("_p", r"=.*$", "").alias("name"), value.alias("value"))


#: IPv4 networks that are not public, as (network, prefix length).
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def ipv4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    part = lambda i: F.get(octets, F.lit(i)).try_cast("long")
    ok = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (F.array_max(F.transform(octets, lambda x: x.try_cast("long"))) <= 255)
    return F.when(ok, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def is_public_v4(ip: Column) -> Column:
    """Whether an IPv4 address is in no private network; null for anything else. A handful of ranges, so no join."""
    n = ipv4_number(ip)
    private = F.lit(False)
    for network, bits in PRIVATE_V4:
        low = sum(int(o) << s for o, s in zip(network.split("."), (24, 16, 8, 0), strict=True))
        private = private | n.between(low, low + (1 << (32 - bits)) - 1)
    return ~private


#: The IPv6 network that public addresses are in, and networks in it that are not public.
PUBLIC_V6, PRIVATE_V6 = "2000::/3", ("2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20")


def _v6_is_public(text: str | None) -> bool | None:
    if text is None or ":" not in text or "%" in text:
        return None
    try:
        at = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return at in ipaddress.IPv6Network(PUBLIC_V6) and not any(at in ipaddress.IPv6Network(n) for n in PRIVATE_V6)


def is_public_v6(ip: Column) -> Column:
    """Whether an IPv6 address is public; null for anything else, as one with a zone."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_v6_is_public(x) for x in s], dtype=object)

    return F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR)(ip)


def is_public(ip: Column) -> Column:
    """Whether an address may be fetched: public IPv4 or IPv6; anything else is not."""
    return F.coalesce(is_public_v4(ip), is_public_v6(ip), F.lit(False))


def page_check(html: Column, title: Column, visible_chars: Column) -> Column:
    """What a page is instead of content: the first matching challenge, login or shell; null for content."""
    low, name = F.lower(html), F.lower(F.coalesce(title, F.lit("")))
    has = lambda *words: F.greatest(*[low.contains(w).cast("int") for w in (*words, words[0])]) == 1
    return (
        F.when(name.contains("just a moment") & has("cloudflare", "cf-chl"), "cloudflare")
        .when(has("smartcaptcha"), "yandex-smartcaptcha")
        .when(has("captcha-delivery.com"), "datadome")
        .when(has("qrator"), "qrator")
        .when(has("ddos-guard"), "ddos-guard")
        .when(has("awswafintegration", "aws-waf-token"), "aws-waf")
        .when((visible_chars < 400) & has("hcaptcha.com"), "hcaptcha")
        .when((visible_chars < 400) & has("google.com/recaptcha"), "recaptcha")
        .when((visible_chars < 400) & has('type="password"'), "login")
        .when((visible_chars < 40) & has("<script"), "shell")
    )
