"""Addresses, IPv4 and IPv6, to networks: the longest matching prefix, as an equi-join on prefixes rather than a range scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.scalar import col, ipv4_number

#: Networks of so few bits have at most 2 ** 13 prefixes a family and are broadcast: many addresses share each of them.
SHORT = 12


def address_hex(ip: Column | str) -> Column:
    """An IPv4 address as 8 hexadecimal digits, an IPv6 address as 32; null for anything else."""
    a = F.lower(F.regexp_replace(col(ip), r"^\[|\]$|%.*$", ""))
    four = ipv4_number(a)
    dotted = F.regexp_extract(a, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 2)
    tail = ipv4_number(dotted)
    spelt = F.when(tail.isNotNull(), F.concat(F.regexp_extract(a, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 1), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(0xFFFF).cast("long"))))).otherwise(a)
    halves = F.split(spelt, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    left, right = groups(0), groups(1)
    n = F.size(left) + F.size(right)
    fine = F.contains(a, F.lit(":")) & spelt.rlike(r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4})+$") & F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n < 8)) & ~spelt.rlike(r"(^|[^:]):$|^:([^:]|$)")
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
    return F.when(four.isNotNull(), F.lpad(F.lower(F.hex(four)), 8, "0")).when(fine, F.lower(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))


def prefix(digits: Column, bits: Column) -> Column:
    """The first bits of an address, as a key: whole digits and what is left of the next one."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.when(rest == 0, "").otherwise(F.floor(digit / F.pow(F.lit(2.0), 4 - rest)).cast("int").cast("string"))
    return F.concat(F.substring(digits, F.lit(1), whole), F.lit("/"), part)


def networks(table: DataFrame, cidr: str = "network") -> DataFrame:
    """A table with CIDR networks, with their address length in digits, prefix length and prefix. A network without length is one address."""
    parts = F.split(cidr, "/")
    digits = address_hex(parts[0])
    bits = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.length(digits) * 4)
    return table.withColumns({"bits": bits, "width": F.length(digits)}).withColumn("low", prefix(digits, F.col("bits")))


def locate(rows: DataFrame, table: DataFrame, ip: str = "ip_address") -> DataFrame:
    """rows joined (left) with the most specific network that holds their address.

    Every distinct address is exploded to its prefix of each length that occurs in the table (at most 33 or 129) and joined by
    equality: with the short prefixes, which many addresses share, by broadcast, with all others by a join that spreads over
    addresses. Of equal networks the least row counts. Rows need not be unique."""
    rest = [c for c in table.columns if c not in ("bits", "low", "width")]
    nets = table.where("low IS NOT NULL").groupBy("width", "bits", "low").agg(F.min(F.struct(*rest)).alias("net"))
    lengths = sorted((r["width"], r["bits"]) for r in nets.select("width", "bits").distinct().limit(33 + 129).collect())
    keyed = rows.select(ip).distinct().withColumn("digits", address_hex(ip)).where("digits IS NOT NULL")

    def hits(some: list[tuple[int, int]], side: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(b).alias("bits"), F.when(F.length("digits") == w, prefix(F.col("digits"), F.lit(b))).alias("low")) for w, b in some]))
        return keyed.select(ip, each.alias("x")).select(ip, "x.*").join(side, ["width", "bits", "low"]).select(ip, "bits", "net")

    short, long = [x for x in lengths if x[1] <= SHORT], [x for x in lengths if x[1] > SHORT]
    found = [hits(some, side) for some, side in ((short, F.broadcast(nets.where(F.col("bits") <= SHORT))), (long, nets.where(F.col("bits") > SHORT))) if some]
    if not found:
        return rows.select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest])
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best = both.groupBy(ip).agg(F.max_by("net", "bits").alias("net"))
    return rows.join(best, ip, "left").select(*rows.columns, *[F.col(f"net.{c}").alias(c) for c in rest])
