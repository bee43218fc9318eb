"""Rates and human-readable quantities."""

from pyspark.sql import Column, functions as F

BYTE_UNITS = ("B", "kB", "MB", "GB", "TB", "PB")
BPS_UNITS = ("bps", "kbps", "Mbps", "Gbps", "Tbps")
ALERT_BPS_UNITS = ("bps", "Kbps", "Mbps", "Gbps", "Tbps")
ALERT_PPS_UNITS = ("pps", "Kpps", "Mpps", "Gpps")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bits_per_second(total_bytes, seconds: float) -> Column:
    return _c(total_bytes) * 8 / F.lit(seconds)


def per_second(total, seconds: float) -> Column:
    return _c(total) / F.lit(seconds)


def humanize(value, units=BYTE_UNITS, base_decimals: int = 0) -> Column:
    """Base-1000 text with two decimals (``base_decimals`` at the smallest unit)."""
    v = _c(value).cast("double")
    out = F.format_string(f"%.2f {units[-1]}", v / F.lit(1000.0 ** (len(units) - 1)))
    for i in range(len(units) - 2, -1, -1):
        digits = base_decimals if i == 0 else 2
        text = F.format_string(f"%.{digits}f {units[i]}", v / F.lit(1000.0**i))
        out = F.when(v < F.lit(1000.0 ** (i + 1)), text).otherwise(out)
    return out


def format_metric(metric_type, value) -> Column:
    """Alert metric text: bps and pps are scaled, counts are whole, the rest keeps two decimals."""
    return (
        F.when(_c(metric_type) == "bps", humanize(value, ALERT_BPS_UNITS, 2))
        .when(_c(metric_type) == "pps", humanize(value, ALERT_PPS_UNITS, 2))
        .when(_c(metric_type) == "count", F.format_string("%.0f", _c(value)))
        .otherwise(F.format_string("%.2f", _c(value)))
    )


def country_flag(code) -> Column:
    """Two-letter code -> regional-indicator pair; anything else -> globe."""
    cc = F.upper(F.trim(_c(code)))

    # A regional indicator is U+1F1E6 + letter index; its UTF-8 form is f0 9f 87 (a6 + index).
    def letter(i):
        last = F.ascii(F.substring(cc, i, 1)) - F.lit(65) + F.lit(0xA6)
        return F.concat(F.lit("F09F87"), F.hex(last.cast("long")))

    pair = F.decode(F.unhex(F.concat(letter(1), letter(2))), "UTF-8")
    return F.when(cc.rlike("^[A-Z]{2}$"), pair).otherwise(F.lit("\U0001f310"))
