"""Autonomous-system numbers: private folding, labels, traffic class."""

from pyspark.sql import Column, functions as F

# Private-use ASN ranges, the folded group and its display name.
PRIVATE_RANGES = ((64512, 65534), (4200000000, 4294967294))
PRIVATE_GROUP = 4294967295
PRIVATE_NAME = "Private / Internal"

CONTENT_RATIO = 4.0
EYEBALL_RATIO = 0.25


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_private(asn) -> Column:
    a = _c(asn)
    return a.between(*PRIVATE_RANGES[0]) | a.between(*PRIVATE_RANGES[1])


def grouped_as(asn) -> Column:
    return F.when(is_private(asn), F.lit(PRIVATE_GROUP).cast("long")).otherwise(_c(asn))


def grouped_as_name(group, name) -> Column:
    """Display name of a folded AS; a missing name is ''."""
    return F.when(_c(group) == PRIVATE_GROUP, F.lit(PRIVATE_NAME)).otherwise(F.coalesce(_c(name), F.lit("")))


def as_label(asn) -> Column:
    return F.when(_c(asn) == PRIVATE_GROUP, F.lit(PRIVATE_NAME)).otherwise(
        F.concat(F.lit("AS"), _c(asn).cast("string"))
    )


def as_key(asn) -> Column:
    """Text key of an AS, with no detail page (NULL) for the folded group."""
    return F.when(_c(asn) != PRIVATE_GROUP, _c(asn).cast("string"))


def asymmetry_ratio(bytes_in, bytes_out) -> Column:
    return F.when((_c(bytes_in) == 0) & (_c(bytes_out) == 0), F.lit(0.0)).otherwise(
        _c(bytes_out) / F.greatest(_c(bytes_in), F.lit(1))
    )


def asymmetry_class(bytes_in, bytes_out) -> Column:
    ratio = asymmetry_ratio(bytes_in, bytes_out)
    return (
        F.when((_c(bytes_in) == 0) & (_c(bytes_out) == 0), "balanced")
        .when(ratio > CONTENT_RATIO, "content")
        .when(ratio < EYEBALL_RATIO, "eyeball")
        .otherwise("balanced")
    )
