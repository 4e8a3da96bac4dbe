"""IP address columns: parsing and the private/reserved test."""

from __future__ import annotations

import ipaddress

from pagewright.functions.sql import Expr as Column, fn as F

from pagewright.functions.text import let

_PRIVATE = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16"]
_PRIVATE6 = ["::1/128", "::/128", "fc00::/7", "fe80::/10"]

# Reserved ranges per dialect.
RANGES = {
    "gateway": _PRIVATE + ["0.0.0.0/32", "224.0.0.0/24"] + _PRIVATE6 + ["ff02::/16"],
    "fast": _PRIVATE + ["0.0.0.0/32"] + _PRIVATE6,
    "browser": _PRIVATE + ["0.0.0.0/8", "100.64.0.0/10", "224.0.0.0/3"] + _PRIVATE6,
}
RANGES["strict"] = sorted(set(sum(RANGES.values(), [])))

# In these dialects an address that cannot be read counts as private.
MALFORMED_IS_PRIVATE = ("browser", "strict")

_OCTET = r"(?:0|[1-9][0-9]{0,2})"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def ipv4_number(ip: Column) -> Column:
    """Dotted decimal (no leading zeros) to BIGINT, NULL if malformed."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    return F.when(ip.rlike(_IPV4) & F.forall(octets, lambda o: o <= 255), number)


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text to 32 lower-case hex digits, NULL if malformed; dotted tails are accepted."""

    def with_tail(s: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(s, r":([0-9.]+)\z", 1))
        tail_hex = F.lpad(F.lower(F.hex(tail)), 8, "0")
        joined = F.concat(
            F.regexp_replace(s, r"[0-9.]+\z", ""), F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4)
        )
        return F.when(s.contains("."), joined).otherwise(s)

    def expand(s: Column) -> Column:
        def groups(text: Column) -> Column:
            return F.filter(F.split(text, ":"), lambda g: g != "")

        short = s.contains("::")
        left = groups(F.substring_index(s, "::", 1))
        right = F.when(short, groups(F.regexp_replace(s, "^.*?::", ""))).otherwise(F.array().cast("array<string>"))

        def build(g: Column) -> Column:
            n = F.size(g["l"]) + F.size(g["r"])
            pad = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(x, 4, "0")), "")
            text = F.concat(pad(g["l"]), F.repeat(F.lit("0000"), (8 - n).cast("int")), pad(g["r"]))
            shape = F.when(short, (n <= 7) & ~s.rlike("::.*::|:::|^:[^:]|[^:]:$")).otherwise(
                s.rlike("^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$")
            )
            return F.when(shape & s.rlike("^[0-9a-f:]+$") & ~s.rlike("[0-9a-f]{5}"), text)

        return let(F.struct(left.alias("l"), right.alias("r")), build)

    return F.when(ip.contains(":"), let(with_tail(F.lower(ip)), expand))


def _in_ranges4(number: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges if ":" not in r]
    test = F.lit(False)
    for net in nets:
        test = test | number.between(int(net.network_address), int(net.broadcast_address))
    return test


def _in_ranges6(text: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges if ":" in r]
    test = F.lit(False)
    for net in nets:
        test = test | text.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return test


def _loose_private4(parts: Column) -> Column:
    """Four all-digit parts; an empty part is zero and a part may exceed 255. Only the first two decide."""

    def part(i: int) -> Column:
        digits = F.regexp_replace(F.get(parts, F.lit(i)), "^0+", "")
        return F.when(F.length(digits) > 9, F.lit(10**9)).when(digits == "", F.lit(0)).otherwise(digits.cast("int"))

    return let(
        F.struct(part(0).alias("a"), part(1).alias("b")),
        lambda n: n["a"].isin(0, 10, 127)
        | (n["a"] >= 224)
        | ((n["a"] == 172) & n["b"].between(16, 31))
        | ((n["a"] == 192) & (n["b"] == 168))
        | ((n["a"] == 100) & n["b"].between(64, 127))
        | ((n["a"] == 169) & (n["b"] == 254)),
    )


def is_private_address(ip: Column, dialect: str = "strict") -> Column:
    """N1. NULL for an unreadable address, except in the dialects that treat it as private."""
    ranges = RANGES[dialect]
    mapped = "0" * 20 + "ffff"

    def v6(text: Column) -> Column:
        inner = F.conv(F.substring(text, 25, 8), 16, 10).cast("long")
        return F.when(text.startswith(mapped), _in_ranges4(inner, ranges)).otherwise(_in_ranges6(text, ranges))

    six = let(ipv6_hex(ip), lambda t: F.when(t.isNotNull(), v6(t)))
    if dialect in MALFORMED_IS_PRIVATE:
        four = F.when(ip.rlike(r"^[0-9]*(?:\.[0-9]*){3}\z"), _loose_private4(F.split(ip, r"\."))).otherwise(F.lit(True))
        return F.when(ip.isNull(), F.lit(True)).otherwise(F.when(ip.contains(":"), F.coalesce(six, F.lit(True))).otherwise(four))
    four = let(ipv4_number(ip), lambda n: F.when(n.isNotNull(), _in_ranges4(n, ranges)))
    return F.when(ip.contains(":"), six).otherwise(four)


def host_is_private_literal(host: Column, dialect: str = "browser") -> Column:
    """True for a (bracketed) address literal that is private; names are never private."""
    bare = F.when(host.rlike(r"(?s)^\[.*\]\z"), F.regexp_replace(host, r"^\[|\]\z", "")).otherwise(host)
    literal = bare.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z") | bare.contains(":")
    return F.when(literal, F.coalesce(is_private_address(bare, dialect), F.lit(False))).otherwise(F.lit(False))
