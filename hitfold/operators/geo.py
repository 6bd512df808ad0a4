"""Address to place by longest matching network.

A ``between`` join would test every pair. A network is a CIDR block, so an address
lies in it exactly when the two agree on the network's leading bits. Each distinct address is cut
to every prefix length in use (at most 33 for IPv4, 129 for IPv6) and joined by
equality, which needs no range test.

Many addresses share a short prefix. Prefixes of up to 16 bits number 131,071 per family at
most, so those networks are broadcast. A longer IPv4 prefix covers 32,768 addresses at most; IPv6 prefixes
have no such bound and are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.functions import ip

PLACE = ("country", "region", "city")
SHORT_PREFIX = 16
V6_SALTS = 16


def _digits(address: str) -> Column:
    """Address as 8 (IPv4) or 32 (IPv6) hex digits, null when it is none."""
    return F.expr(
        f"CASE WHEN {ip.is_v4(address)} THEN {ip.v4_hex(address)} ELSE {ip.v6_hex(address)} END"
    )


def _prefix(digits: Column, length: Column) -> Column:
    """The leading ``length`` bits of hex digits, as text."""
    whole = F.floor(length / 4).cast("int")
    rest = F.pmod(length, F.lit(4))
    nibble = F.conv(digits.substr(whole + 1, F.lit(1)), 16, 10).cast("int")
    kept = nibble - F.pmod(nibble, F.pow(F.lit(2), 4 - rest).cast("int"))
    partial = F.when(rest > 0, F.lower(F.hex(kept.cast("bigint")))).otherwise(F.lit(""))
    return F.concat(digits.substr(F.lit(1), whole), partial)


def network_keys(networks: DataFrame) -> DataFrame:
    """(family, length, prefix, country, region, city) of each network.

    Networks come as CIDR text in ``network``, or as IPv4 blocks in ``start`` and ``end``.
    """
    if "network" in networks.columns:
        bits = F.when(F.contains("network", F.lit(":")), F.lit(128)).otherwise(F.lit(32))
        given = F.regexp_extract("network", "/([0-9]+)$", 1).try_cast("int")
        keyed = networks.withColumn("_a", F.substring_index("network", "/", 1)).select(
            _digits("_a").alias("digits"), F.coalesce(given, bits).alias("length"), *PLACE
        )
    else:
        size = (F.col("end") - F.col("start") + 1).cast("bigint")
        keyed = networks.select(
            F.lpad(F.lower(F.hex(F.col("start").cast("bigint"))), 8, "0").alias("digits"),
            (F.lit(33) - F.length(F.bin(size))).alias("length"),
            *PLACE,
        )
    return keyed.where(F.col("digits").isNotNull()).select(
        F.when(F.length("digits") == 8, F.lit(4)).otherwise(F.lit(6)).alias("family"),
        "length",
        _prefix(F.col("digits"), F.col("length")).alias("prefix"),
        *PLACE,
    )


def lengths_in_use(keys: DataFrame) -> Column:
    """Distinct (family, prefix length), at most 33 + 129, as one array in a subquery of the plan that asks."""
    return keys.agg(F.array_sort(F.collect_set(F.struct("family", "length")))).scalar()


def locate(
    addresses: DataFrame, networks: DataFrame, column: str = "remote_addr"
) -> DataFrame:
    """Location text, country, region and city of each distinct address."""
    distinct = addresses.select(F.col(column).alias("address")).distinct()
    return with_location(distinct, "address", networks)


def with_location(
    rows: DataFrame, column: str, networks: DataFrame | None = None
) -> DataFrame:
    """Add location, country, region and city to distinct rows that name an address.

    Without networks only the class of the address is told.
    """
    if networks is None:
        label = F.expr(ip.class_label(ip.address_class(column)))
        return rows.withColumns({"location": label, **{name: F.lit("") for name in PLACE}})
    keys = network_keys(networks)
    in_use = lengths_in_use(keys)
    own = rows.columns
    classed = rows.withColumn("_a", F.trim(column)).select(
        *own, F.expr(ip.address_class("_a")).alias("class"), _digits("_a").alias("digits"), in_use.alias("_use")
    )

    # only public addresses are looked up, the others have a fixed label
    family = F.when(F.length("digits") == 8, F.lit(4)).otherwise(F.lit(6))
    own_lengths = F.filter("_use", lambda use: use["family"] == family)
    cuts = F.when(
        F.col("class") == "public",
        F.transform(
            own_lengths,
            lambda use: F.struct(
                use["family"].alias("family"), use["length"].alias("length"),
                _prefix(F.col("digits"), use["length"]).alias("prefix"),
            ),
        ),
    )
    spread = F.xxhash64(column)
    v6_salt = F.when(F.col("p.family") == 6, F.pmod(spread, F.lit(V6_SALTS))).otherwise(F.lit(0))
    probes = classed.select(*own, "class", F.explode_outer(cuts).alias("p")).select(
        *own,
        "class",
        "p.*",
        # short cuts have no partner among the long ones: their salt only spreads them
        F.when(F.col("p.length") > SHORT_PREFIX, v6_salt).otherwise(spread).alias("salt"),
    )
    cut = ["family", "length", "prefix"]
    place = F.struct("length", *PLACE)
    short = keys.where(F.col("length") <= SHORT_PREFIX).groupBy(*cut).agg(F.max(place).alias("wide"))
    zero = F.lit(0).cast("bigint")
    salts = F.when(
        F.col("family") == 6, F.sequence(zero, F.lit(V6_SALTS - 1).cast("bigint"))
    ).otherwise(F.array(zero))
    long = keys.where(F.col("length") > SHORT_PREFIX).select(
        *cut, place.alias("narrow"), F.explode(salts).alias("salt")
    )
    located = (
        probes.join(F.broadcast(short), cut, "left")
        .join(long, [*cut, "salt"], "left")
        .groupBy(*own, "class")
        .agg(F.max(F.coalesce("narrow", "wide")).alias("p"))
    )
    text = {name: F.coalesce(F.col(f"p.{name}"), F.lit("")) for name in PLACE}
    location = F.when(
        F.col("class") == "public",
        F.expr(ip.place_name(*[f"coalesce(p.{name}, '')" for name in PLACE])),
    ).otherwise(F.expr(ip.class_label("class")))
    return located.select(
        *own, location.alias("location"), *[text[name].alias(name) for name in PLACE]
    )
