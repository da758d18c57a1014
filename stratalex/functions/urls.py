"""URLs: normal form, source names, filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def normalise(url: Column) -> Column:
    """http and https only; lower-case host, port kept, no fragment, one trailing slash off."""
    scheme = F.regexp_extract(url, r"^([A-Za-z]+)://", 1)
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*(:\d+)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.concat(scheme, F.lit("://"), host(url), port, F.when(path(url) == "", "/").otherwise(path(url)), query)
    bare = F.concat(scheme, F.lit("://"), host(url), port, F.lit("/"))
    out = F.when((whole != bare) & F.endswith(whole, F.lit("/")), F.regexp_replace(whole, "/$", "")).otherwise(whole)
    return F.when(F.lower(scheme).isin("http", "https") & (host(url) != ""), out)


def source_name(url: Column) -> Column:
    """Host and last part of the path, without its extension, as a name of at most 80 characters.

    A slash at the end doesn't count, a dot at the start of the part is no extension's, and
    a path of slashes alone has no name of its own.
    """
    of = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    last = F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1)
    stem = F.regexp_replace(last, r"^(.+)\.[^.]*$", "$1")
    named = F.regexp_replace(F.substring(F.concat(of, F.lit("_"), stem), 1, 80), r"[^A-Za-z0-9_\-\u4e00-\u9fff]", "_")
    return F.when(path(url).isin("", "/"), F.concat(of, F.lit("_index"))).when(last == "", "crawled_page").otherwise(named)


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    if not domains:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(host(url) == d) | F.endswith(host(url), F.lit(f".{d}")) for d in domains])


def in_paths(url: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(w.lower())) for w in words])


_AUTHORITY = r"^\s*[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Bounds of the addresses that stay inside a network: loopback, private, link-local, and 0.0.0.0.
_INSIDE_4 = [(0, 0), (0x0A000000, 0x0AFFFFFF), (0x7F000000, 0x7FFFFFFF), (0xA9FE0000, 0xA9FEFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0A80000, 0xC0A8FFFF)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def _number(part: Column, octal: bool) -> Column:
    """A decimal or hexadecimal number, with ``octal`` an octal one after a zero; else null."""
    plain = F.when(F.rlike(part, F.lit(r"^\d{1,18}$")), part.cast("long"))
    if octal:
        plain = F.when(F.rlike(part, F.lit(r"^0[0-7]{1,18}$")), F.conv(part, 8, 10).cast("long")).otherwise(plain)
    return F.when(F.rlike(part, F.lit(r"^0x[0-9a-f]{1,14}$")), F.conv(F.substring(part, 3, 14), 16, 10).cast("long")).otherwise(plain)


def _address_4(host: Column, octal: bool) -> Column:
    """The number of an IPv4 address of one to four parts, of which the last fills what is left; null for a name."""

    def whole(parts: Column) -> Column:
        last, n = F.element_at(parts, -1), F.size(parts)
        units = F.array(*[F.lit(1 << k).cast("long") for k in (24, 16, 8)])
        shifted = F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(units, F.lit(1), n - 1), lambda p, unit: F.when(p <= 255, p * unit))
        return F.when((n <= 4) & (last < F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in (32, 24, 16, 8)]), F.least(n, F.lit(4)))), F.aggregate(shifted, last, lambda a, x: a + x))

    return _let(F.transform(F.split(host, r"\."), lambda p: _number(p, octal)), whole)


def _inside_4(number: Column) -> Column:
    return _let(number, lambda v: F.coalesce(reduce(lambda a, b: a | b, [v.between(low, high) for low, high in _INSIDE_4]), F.lit(False)))


def _groups_6(inner: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it has another number of them."""
    some = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")

    def hexed(plain: Column) -> Column:
        tail = _address_4(F.regexp_extract(plain, r"(\d+\.\d+\.\d+\.\d+)$", 1), False)
        both = _let(tail, lambda v: F.concat(F.hex(F.floor(v / 65536).cast("long")), F.lit(":"), F.hex(v % 65536)))
        return F.when(F.contains(plain, F.lit(".")), F.concat(F.regexp_extract(plain, r"^(.*:)", 1), both)).otherwise(plain)

    def filled(two: Column) -> Column:
        left, right = two["left"], two["right"]
        zeros = F.when(right.isNotNull(), F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))).otherwise(none)
        return F.concat(left, zeros, F.coalesce(right, none))

    halves = lambda plain: F.struct(some(F.substring_index(plain, "::", 1)).alias("left"), F.when(F.contains(plain, F.lit("::")), some(F.substring_index(plain, "::", -1))).alias("right"))
    every = _let(_let(_let(F.regexp_replace(inner, "%.*$", ""), hexed), halves), filled)
    return _let(every, lambda e: F.when(F.size(e) == 8, F.transform(e, lambda g: F.conv(g, 16, 10).cast("long"))))


def _inside_6(groups: Column) -> Column:
    first, zeros = F.get(groups, 0), lambda n: ~F.exists(F.slice(groups, 1, n), lambda g: g != 0)
    local = (first.between(0xFC00, 0xFDFF)) | (first.between(0xFE80, 0xFEFF)) | (zeros(7) & (F.get(groups, 7) <= 1))
    mapped = zeros(5) & (F.get(groups, 5) == 0xFFFF) & _inside_4(F.get(groups, 6) * 65536 + F.get(groups, 7))
    return F.coalesce(local | mapped, F.lit(False))


def _host_reason(host: Column) -> Column:
    v6 = lambda groups: F.when(groups.isNull(), "host").when(_inside_6(groups), "address")
    name = lambda h: F.when(_inside_4(_address_4(h, False)) | _inside_4(_address_4(h, True)) | F.rlike(h, F.lit(r"^(.*\.)?localhost$")), "address")
    bracketed = _let(_groups_6(F.regexp_extract(host, r"^\[(.*)\]$", 1)), v6)
    return F.when(host == "", "host").when(F.startswith(host, F.lit("[")), bracketed).otherwise(_let(F.regexp_replace(host, r"\.$", ""), name))


def unsafe_reason(url: Column) -> Column:
    """Null, or why a URL must not be fetched: scheme, host or address.

    Addresses are compared as numbers, whether decimal, hexadecimal, octal or short (a part
    with a zero in front counts in both ways); of IPv6 ``::``, ``::1``, fc00::/7, fe80::/10,
    fec0::/10 and IPv4 ones inside.  Names aren't resolved, but ``localhost`` is known.
    """
    scheme = F.coalesce(F.lower(F.regexp_extract(url, r"^\s*([A-Za-z]+)://", 1)), F.lit(""))
    return F.when(~scheme.isin("http", "https"), "scheme").otherwise(_let(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), _host_reason))


def is_redirect(status: Column) -> Column:
    return status.isin(301, 302, 303, 307, 308)


def completions_url(base: Column) -> Column:
    return F.when(F.rlike(base, F.lit("^https?://")), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/chat/completions")))
