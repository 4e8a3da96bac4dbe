"""Longest-prefix join of addresses with a table of address ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.addresses import RANGES, ipv4_number, ipv6_hex
from pagewright.functions.sql import Expr, expr, fn as F
from pagewright.functions.text import let
from pagewright.session import write_through

#: Where IPv4 stands among 128-bit addresses: ::ffff:0:0/96.
MAPPED_BITS = 96


def address_bits(ip) -> Expr:
    """STRUCT<hi, lo>, the two halves of an address as signed longs; NULL if it can't be read. IPv4 is the mapped IPv6 address."""
    ip = expr(ip)
    half = lambda text, at: F.conv(F.substring(text, at, 16), 16, -10).cast("long")
    six = let(ipv6_hex(ip), lambda h: F.when(h.isNotNull(), F.struct(half(h, 1).alias("hi"), half(h, 17).alias("lo"))))
    four = let(ipv4_number(ip), lambda n: F.when(n.isNotNull(), F.struct(F.lit(0).cast("long").alias("hi"), (n + (0xFFFF << 32)).alias("lo"))))
    return F.when(ip.contains(":"), six).otherwise(four)


def prefix_of(bits: Expr, length: Expr) -> Expr:
    """STRUCT<length, hi, lo>: the first ``length`` bits of an address, the others zero."""

    def first(half: str, n: Expr) -> Expr:
        return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, bits[half]).otherwise(Expr(f"({bits[half].text} & shiftleft(-1L, CAST(64 - {n.text} AS INT)))"))

    return F.struct(length.alias("length"), first("hi", length).alias("hi"), first("lo", length - 64).alias("lo"))


def parsed_ranges(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(length, hi, lo, range): one row per prefix, ``range`` holding the columns of its row.

    A range is ``address/bits`` or a single address; bits after the prefix are ignored, and so are rows that can't be read.
    Of rows with one prefix the first by all columns in order stands.
    """
    text = F.col(f"`{cidr}`")
    bits = F.when(text.contains("/"), F.when(text.rlike(r"^[^/]+/[0-9]{1,3}\z"), F.regexp_extract(text, r"/([0-9]+)\z", 1).cast("int"))).otherwise(F.when(text.contains(":"), 128).otherwise(32))
    length = bits + F.when(text.contains(":"), 0).otherwise(MAPPED_BITS)
    read = ranges.select(S.struct("*").alias("range"), address_bits(F.substring_index(text, "/", 1)).alias("_bits").col, length.alias("_length").col)
    # A prefix past its address family's length is unreadable.
    read = read.filter("_bits IS NOT NULL AND _length BETWEEN 0 AND 128")
    key = prefix_of(F.col("_bits"), F.col("_length"))
    return read.select("range", key.alias("_key").col).groupBy("_key.length", "_key.hi", "_key.lo").agg(S.min("range").alias("range"))


def longest_prefixes(addresses: DataFrame, ip: str, ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(ip, bits, range): for each distinct address inside a range, the range with the longest prefix, and its length of 128.

    Ranges are split by their lengths; an address looks up its own prefix of each length that occurs, at most 129, so the
    join is an equal one at any number of ranges. The side of the ranges has one row per key and is a written table: a
    prefix that most addresses share makes only their side large, which adaptive execution splits, and it
    is broadcast only where its measured size allows.
    """
    table = write_through(parsed_ranges(ranges, cidr))
    lengths = sorted(r.length for r in table.select("length").distinct().collect())  # at most 129
    distinct = addresses.select(S.col(ip).alias("ip")).filter("ip IS NOT NULL").distinct()
    bits = distinct.withColumn("_bits", address_bits(F.col("ip")).col).filter("_bits IS NOT NULL")
    occurring = Expr("array(" + ", ".join(map(str, lengths)) + ")") if lengths else Expr("CAST(array() AS array<int>)")
    keys = bits.select("ip", S.explode(F.transform(occurring, lambda n: prefix_of(F.col("_bits"), n)).col).alias("_key")).select("ip", "_key.*")
    found = keys.join(table, ["length", "hi", "lo"])
    return found.groupBy("ip").agg(S.max(S.struct("length", "hi", "lo")).alias("_m"), S.max_by("range", "length").alias("range")).select("ip", S.col("_m.length").alias("bits"), "range")


def match_ranges(df: DataFrame, ip: str, ranges: DataFrame, cidr: str = "cidr", name: str = "range") -> DataFrame:
    """``df`` with the column ``name``: the row of ``ranges`` with the longest prefix that holds the address, or NULL.

    Unreadable and NULL addresses match nothing. Copies of an address are looked up once.
    """
    found = write_through(longest_prefixes(df, ip, ranges, cidr)).select(S.col("ip").alias("_matched_ip"), S.col("range").alias(name))
    return df.join(found, S.col(ip) == S.col("_matched_ip"), "left").drop("_matched_ip")


def reserved_ranges(spark, dialect: str = "strict") -> DataFrame:
    """The fixed reserved ranges of a dialect as a table (cidr, kind); callers add their own rows."""
    return spark.createDataFrame([(r, "reserved") for r in RANGES[dialect]], "cidr string, kind string")
