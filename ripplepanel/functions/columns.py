"""Small Column expressions: nulls, clipping, binning, hashing, rounding, text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EM_DASH = "—"


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not survive a scan."""
    return F.when(~F.isnan(c), c)


def clip_low(c: Column, low: float = 0.0) -> Column:
    return F.greatest(F.coalesce(c, F.lit(low)), F.lit(low))


def portable_hash(*parts: Column | str, seed: int | str) -> Column:
    """32 bits of md5 as a long: the same number in any engine with md5."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit_interval(h: Column) -> Column:
    return h / F.lit(4294967296.0)


# Cumulative probabilities of a Poisson variable with mean 1.
POISSON_ONE_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058,
    0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
    0.9999167588507119,
)


def poisson_one(h: Column) -> Column:
    """Poisson(1) bootstrap weight from a portable hash."""
    u = unit_interval(h)
    out = F.lit(float(len(POISSON_ONE_CDF)))
    for k in range(len(POISSON_ONE_CDF) - 1, -1, -1):
        out = F.when(u < POISSON_ONE_CDF[k], F.lit(float(k))).otherwise(out)
    return out


def right_closed_bin(c: Column, edges: Sequence[float], include_lowest: bool = True) -> Column:
    """1-based index of the interval (e[i-1], e[i]] holding ``c``, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low = c >= edges[i - 1] if include_lowest and i == 1 else c > edges[i - 1]
        out = F.when(low & (c <= edges[i]), F.lit(i)).otherwise(out)
    return out


def equal_width_bin(c: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based histogram bin; the last bin is closed on both sides."""
    width = (high - low) / F.lit(float(bins))
    raw = F.floor((c - low) / width).cast("int")
    return F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))


def stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    )


def fixed(c: Column, digits: int = 4) -> Column:
    """Decimal text with an em dash for null."""
    # the nudge makes a value midway between two decimals round up everywhere
    scaled = F.floor(c * F.lit(10.0**digits) + F.lit(0.5 + 1e-6)) / F.lit(10.0**digits)
    return F.when(c.isNull(), EM_DASH).otherwise(F.format_string(f"%.{digits}f", scaled))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def round4(c: Column) -> Column:
    """Four decimals with exact ties nudged up, and no negative zero."""
    return F.floor(c * F.lit(1e4) + F.lit(0.5 + 1e-6)) / F.lit(1e4) + F.lit(0.0)


def present(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Report form: rounded doubles, long integers, ISO dates, 0/1 flags."""
    keep = set(keep)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in keep:
            pass
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round4(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = round4(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)
