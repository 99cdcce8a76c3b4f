"""Addresses as numbers: 128 bits as 32 hexadecimal digits, in order as text; networks, and the longest one of an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import IPV4, OCTET, text

_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[^:]|::)(?!.*::.*::)(?!.*[^:]:$)(?=.*::)(?!.*:::)(?!(?:[^:]+:+){{7}}[^:]+)(?!:+(?:[^:]+:+){{7}}[^:]+)(?:(?:{_GROUP})?:)*(?:{_GROUP})?)$"
_MAPPED = rf"^([0-9A-Fa-f:]*:)({OCTET}(?:\.{OCTET}){{3}})$"


def _v4_hex(v: Column) -> Column:
    return F.array_join(F.transform(F.split(v, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")


def _v6_hex(v: Column) -> Column:
    """Both sides of `::` with zeros between."""
    digits = lambda side: F.array_join(F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    left, right = digits(F.substring_index(v, "::", 1)), digits(F.when(F.contains(v, F.lit("::")), F.substring_index(v, "::", -1)).otherwise(""))
    return F.concat(left, F.repeat(F.lit("0"), F.lit(32) - F.length(left) - F.length(right)), right)


def ip_key(v: Column) -> Column:
    """The 32 digits of an address, version 4 as ::ffff:a.b.c.d; brackets, quotes and a zone are left out. Null if it isn't one."""
    s = F.substring_index(F.btrim(text(v), F.lit("[]")), "%", 1)
    tail = F.regexp_extract(s, _MAPPED, 2)
    octets = _v4_hex(tail)
    plain = F.when(s.rlike(_MAPPED), F.concat(F.regexp_extract(s, _MAPPED, 1), F.substring(octets, 1, 4), F.lit(":"), F.substring(octets, 5, 4))).otherwise(s)
    return F.when(s.rlike(IPV4), F.concat(F.lit("0" * 20 + "ffff"), _v4_hex(s))).when(plain.rlike(IPV6), _v6_hex(plain))


def prefix(key: Column, bits: Column) -> Column:
    """The first bits of a key: whole digits, then one digit with its low bits cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.call_function("shiftleft", F.lit(1), F.lit(4) - rest)
    return F.when(rest == 0, F.substring(key, F.lit(1), whole)).otherwise(F.concat(F.substring(key, F.lit(1), whole), F.lower(F.hex(digit - digit % step))))


def networks(table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """table with bits (of 128) and network (their prefix); rows that are no network are left out."""
    own = F.substring_index(cidr, "/", 1)
    key, size = ip_key(own), F.when(F.contains(cidr, F.lit("/")), F.substring_index(cidr, "/", -1).try_cast("int"))
    most = F.when(F.contains(own, F.lit(":")), 128).otherwise(32)
    bits = F.when(size.isNull() & F.contains(cidr, F.lit("/")), None).when(F.coalesce(size, most).between(0, most), F.coalesce(size, most) + 128 - most)
    out = table.withColumns({"__key": key, "bits": bits.cast("int")}).where("__key IS NOT NULL AND bits IS NOT NULL")
    return out.withColumn("network", prefix(F.col("__key"), F.col("bits"))).drop("__key")


def with_network(rows: DataFrame, address: str, table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """rows with the columns of the longest network of table that holds their address; null where none does.

    An interval join without a nested loop: each distinct address is looked up once for each prefix length that the table
    has (129 at most), by equality of the prefix; of several networks of one length the first by cidr counts.
    """
    nets = networks(table, cidr)
    names = [c for c in table.columns]
    one = nets.groupBy("bits", "network").agg(F.min_by(F.struct(*names), cidr).alias("net"))
    lengths = sorted(r["bits"] for r in nets.select("bits").distinct().collect())
    keyed = rows.withColumn("__ip", ip_key(F.col(address)))
    asked = keyed.select("__ip").where("__ip IS NOT NULL").distinct().select("__ip", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("bits"))
    hits = asked.withColumn("network", prefix(F.col("__ip"), F.col("bits"))).join(one, ["bits", "network"])
    best = hits.groupBy("__ip").agg(F.max_by("net", "bits").alias("__net"))
    return keyed.join(best, "__ip", "left").select(*rows.columns, *(F.col(f"__net.{c}").alias(c) for c in names))
