"""Links, image sources, document scopes and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, utf16_length

_CONTROL = r"[\x00-\x20\x7f-\x9f]+"
#: What no host may hold once it is decoded, and the characters of addresses in brackets.
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f\ufffd]"
_GROUPS = r"(?i)\A[0-9a-f:.]+\z"
_IMAGE_DATA = r"(?i)\Adata:image/(?:png|jpe?g|gif|webp);base64,[a-z0-9+/=\s]+\z"


def _number(label: Column) -> Column:
    """A label's value as a number in one of the three forms of addresses: ``0x`` hex, ``0`` octal, decimal; else null."""
    value = lambda digits, base: F.conv(digits, base, 10).try_cast("decimal(38,0)")
    return (
        F.when(label.rlike(r"(?i)\A0x[0-9a-f]*\z"), F.coalesce(value(F.regexp_replace(label, r"\A0[xX]0*", ""), 16), F.lit(0).cast("decimal(38,0)")))
        .when(label.rlike(r"\A0[0-7]+\z"), value(label, 8))
        .when(label.rlike(r"\A(?:0|[1-9][0-9]*)\z"), label.try_cast("decimal(38,0)"))
    )


def _is_ipv4(labels: Column) -> Column:
    """One to four numbers, the last of which fills the bytes that are left."""
    n = F.size(labels)
    numbers = F.transform(labels, _number)
    small = F.forall(F.slice(numbers, F.lit(1), n - 1), lambda x: x < 256)
    return (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.coalesce(small & (F.get(numbers, n - 1) < F.pow(F.lit(256.0), 5 - n).cast("decimal(20,0)")), F.lit(False))


def _is_ipv6(inner: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer around one ``::``; the last two may be four small decimals."""
    last = F.regexp_extract(inner, r":([0-9]+(?:\.[0-9]+)+)\z", 1)
    whole = F.when(last != "", F.concat(F.substring(inner, F.lit(1), F.length(inner) - F.length(last)), F.lit("0:0"))).otherwise(inner)
    dotted = (last == "") | last.rlike(r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z")
    groups = F.filter(F.split(whole, ":", -1), lambda g: g != "")
    gaps = F.regexp_count(whole, F.lit("::+"))
    fine = F.forall(groups, lambda g: g.rlike(r"(?i)\A[0-9a-f]{1,4}\z")) & ~whole.contains(":::") & ~whole.rlike(r"\A:[^:]|[^:]:\z|\A:\z")
    return inner.rlike(_GROUPS) & dotted & fine & F.when(gaps == 0, F.size(groups) == 8).otherwise((gaps == 1) & (F.size(groups) <= 7))


def valid_host(raw: Column) -> Column:
    """Whether a web address may have the host: a name without forbidden characters, or an address of numbers that fits."""

    def name(host: Column) -> Column:
        labels = F.split(host, r"\.", -1)
        labels = F.when((F.size(labels) > 1) & (F.try_element_at(labels, F.lit(-1)) == ""), F.slice(labels, F.lit(1), F.size(labels) - 1)).otherwise(labels)

        def checked(labels: Column) -> Column:
            tail = F.try_element_at(labels, F.lit(-1))
            return F.when(tail.rlike(r"(?i)\A(?:[0-9]+|0x[0-9a-f]*)\z"), _is_ipv4(labels)).otherwise(F.lit(True))

        return (host != "") & ~host.rlike(_FORBIDDEN) & let(labels, checked)

    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    bracketed = F.endswith(raw, F.lit("]")) & _is_ipv6(F.substring(raw, F.lit(2), F.length(raw) - 2))
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")), bracketed).otherwise(let(decoded, name)), F.lit(False))


def safe_url(raw: Column | str) -> Column:
    """The link as its author spelled it, if it is absolute and of a safe scheme, else null.

    A web address is cut into user, host, port and what is behind as browsers do: any slashes, or none, part the scheme from
    the host, and the last at-sign parts the user from it. Names are not looked up or mapped to ASCII.
    """
    candidate = lambda c: F.when(c.rlike(r"(?i)\Awww\."), F.concat(F.lit("https://"), c)).otherwise(c)

    def checked(c: Column) -> Column:
        place = F.regexp_replace(F.regexp_extract(c, r"(?i)\Ahttps?:[/\\]*([^/\\?#]*)", 1), r"\A.*@", "")
        port = lambda p: F.regexp_extract(p, r":([0-9]*)\z", 1)
        host = lambda p: F.regexp_replace(p, r":[0-9]*\z", "")
        web = let(place, lambda p: valid_host(host(p)) & F.coalesce((port(p) == "") | (port(p).try_cast("decimal(38,0)") <= 65535), F.lit(False)))
        return F.when(c.rlike(r"(?i)\A(?:mailto|tel):"), c).when(c.rlike(r"(?i)\Ahttps?:") & web, c)

    return let(let(F.regexp_replace(col(raw), _CONTROL, ""), candidate), checked)


def safe_image_source(raw: Column | str) -> Column:
    return F.when(col(raw).rlike(_IMAGE_DATA), col(raw)).otherwise(let(safe_url(raw), lambda url: F.when(url.rlike(r"\Ahttps?:"), url)))


def trim_url(url: Column | str) -> Column:
    """Without punctuation behind it, and without closing brackets that nothing opened."""

    def balanced(u: Column) -> Column:
        surplus = F.regexp_count(u, F.lit(r"\)")) - F.regexp_count(u, F.lit(r"\("))
        drop = F.greatest(F.lit(0), F.least(F.length(F.regexp_extract(u, r"(\)*)\z", 1)), surplus))
        return F.substring(u, F.lit(1), F.length(u) - drop)

    return let(F.regexp_replace(col(url), r"[.,;:!?*_~]+\z", ""), balanced)


def bare_urls(text: Column | str) -> Column:
    """All plain addresses in a text, trimmed."""
    found = F.regexp_extract_all(col(text), F.lit(r"(?<![\w@/])((?:https?://|www\.)[^\s<>\"'`]+)"), F.lit(1))
    return F.transform(found, trim_url)


def style_scope(url: Column | str) -> Column:
    """``gdoc:<id>`` of a document address, else ``site:<host>``; null where there is no web address."""
    u = col(url)
    web = u.rlike(r"(?i)\Ahttps?://[^/?#]+")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#]+)", 1), r":[0-9]*\z", ""))
    doc = F.regexp_extract(u, r"(?i)\Ahttps?://[^/?#]+/document/(?:u/[0-9]+/)?d/([A-Za-z0-9_-]{10,})", 1)
    return F.when(web & (host == "docs.google.com") & (doc != ""), F.concat(F.lit("gdoc:"), doc)).when(web & (host != ""), F.concat(F.lit("site:"), host))


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def fingerprint(text: Column | str) -> Column:
    """Length and hash of the first 400 letters and digits, in lower case; empty under three of them."""
    core = F.substring(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", ""), 1, 400)
    codes = F.transform(F.filter(F.split(core, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    hashed = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, x: F.pmod(h * 33 + x, F.lit(4294967296)))
    return F.when(F.length(core) < 3, "").otherwise(F.concat(utf16_length(core).cast("string"), F.lit(":"), F.lower(F.conv(hashed.cast("string"), 10, 36))))
