"""Address scopes kept as tables: CIDR lists of any size, met by equi-joins instead of one predicate per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.addr import UNSPECIFIED, V4_PREFIX, binary, is_v4, network_of, to_ip16
from ..plans.sizing import materialize


def networks(cidrs: DataFrame, column: str = "cidr") -> DataFrame:
    """Adds ``net`` (16 bytes) and ``length`` (on 128 bits) of a CIDR or bare address text; rows with other texts are dropped.

    A bare address is a network of its own, /n of an IPv4 address counts as /(n + 96), bits behind the length are cleared.
    """
    text = F.btrim(F.col(column))
    address, bits = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    four = ~address.contains(":")
    given = F.when(text.contains("/"), F.when(bits.rlike("^[0-9]{1,3}$"), bits.cast("int"))).otherwise(F.when(four, 32).otherwise(128))
    # malformed addresses read as '::', which only zero groups may be
    named = address.contains(":") | address.contains(".")  # other texts are no addresses; told before they are parsed
    zeros = address.rlike("^((0{1,4}:){0,6}0{1,4})?::((0{1,4}:){0,6}0{1,4})?$|^(0{1,4}:){7}0{1,4}$")
    parsed = cidrs.withColumns({"_ip": to_ip16(address), "_bits": given, "_four": four})
    good = F.col("_bits").between(0, F.when(F.col("_four"), 32).otherwise(128)) & ((F.col("_ip") != binary(UNSPECIFIED)) | zeros) & (F.size(F.split(text, "/")) <= 2)
    length = F.when(F.col("_four"), F.col("_bits") + 96).otherwise(F.col("_bits"))
    kept = parsed.filter(named & good).withColumn("length", length.cast("int"))
    return kept.withColumn("net", network_of("_ip", F.col("length"))).drop("_ip", "_bits", "_four")


def scope_table(cidrs: DataFrame, key: str = "scope", column: str = "cidr") -> DataFrame:
    """(key, net, length): the networks of every scope, without those that lie inside another of the same scope.

    What is left of a scope is disjoint, so an address meets it once. Networks nest or are apart, so the outer ones are found by masking a network to
    each shorter length that occurs. Texts and networks are written once: the parsing filters would otherwise be pushed below the distinct, to every
    row of the list, and run again in each branch.
    """
    texts = materialize(cidrs.select(F.col(key).alias("key"), F.col(column).alias("cidr")).distinct(), "cidr-texts")  # a repeated text is parsed once
    nets = materialize(networks(texts).select("key", "net", "length").distinct(), "networks")
    outer = nets.select("key", F.col("net").alias("_net"), F.col("length").alias("_length"))
    lengths = sorted(r[0] for r in nets.select("length").distinct().collect())  # 129 at most
    if len(lengths) > 1:
        shorter = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.col("length"))
        inside = nets.withColumn("_length", F.explode(shorter)).withColumn("_net", network_of("net", F.col("_length")))
        inside = inside.join(outer, ["key", "_net", "_length"], "left_semi").select("key", "net", "length").distinct()
        nets = nets.join(inside, ["key", "net", "length"], "left_anti")
    return nets.select(F.col("key").alias(key), "net", "length")


def members(addresses: DataFrame, ip16: str, scopes: DataFrame, key: str = "scope") -> DataFrame:
    """(ip16, key): the scopes each distinct address lies in; ``scopes`` is a :func:`scope_table`.

    An address is masked to the lengths that networks of its family have, and all lengths meet the table in one equi-join on (net, length).
    Networks that hold all mapped addresses, such as ::/0, serve both families.
    """
    around = (F.col("length") < 96) & (F.col("net") == network_of(binary(V4_PREFIX + bytes(4)), F.col("length")))
    found = scopes.select("length", is_v4("net").alias("v4"), around.alias("around")).distinct().collect()  # 129 lengths at most
    four, six = {r.length for r in found if r.v4 or r.around}, {r.length for r in found if not r.v4}

    def array(lengths):
        return F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")

    hosts = addresses.select(ip16).filter(F.col(ip16).isNotNull()).distinct()
    probes = hosts.withColumn("length", F.explode(F.when(is_v4(ip16), array(four)).otherwise(array(six))))
    return probes.withColumn("net", network_of(ip16, F.col("length"))).join(scopes, ["net", "length"]).select(ip16, key)


def within(rows: DataFrame, ip16: str, cidrs: DataFrame, column: str = "cidr") -> DataFrame:
    """Rows whose address lies in a CIDR list kept as a table; a list without a valid entry keeps every row, as :func:`in_cidrs` does.

    The disjoint networks are written once, so the list is parsed once however often the plan reads them.
    """
    table = materialize(scope_table(cidrs.withColumn("scope", F.lit(0)), column=column), "scope")
    if table.isEmpty():
        return rows
    return rows.join(members(rows, ip16, table).select(ip16), ip16, "left_semi")


def with_scopes(rows: DataFrame, ip16: str, scopes: DataFrame, key: str = "scope", out: str = "scopes") -> DataFrame:
    """Adds the array of the scopes each address lies in, null for none."""
    found = members(rows, ip16, scopes, key).groupBy(ip16).agg(F.collect_set(key).alias(out))
    return rows.join(found, ip16, "left")
