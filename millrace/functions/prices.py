"""Prices, ticks, symbols, labels: column expressions without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = 0.25
#: Plain decimal numbers; other spellings that some parsers accept (1_000, nan) are not prices.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

#: Phrases that name an instrument, in the order in which they are tried.
PHRASES = (
    (("NASDAQ",), "NQ"),
    (("CRUDE OIL", "LIGHT CRUDE", "WTI"), "CL"),
    (("BITCOIN",), "BTC"),
    (("GOLD",), "GC"),
    (("RUSSELL",), "RTY"),
    (("S&P",), "ES"),
    (("GBP/JPY", "GBPJPY", "GBP JPY"), "GBPJPY"),
)
#: Tickers and their symbol.
TICKERS = {
    "NQ": "NQ", "MNQ": "NQ", "NDX": "NQ", "CL": "CL", "MCL": "CL", "BTC": "BTC", "XBT": "BTC",
    "GC": "GC", "MGC": "GC", "RTY": "RTY", "M2K": "RTY", "ES": "ES", "MES": "ES",
}
#: What makes a level's label a term of the method.
METHOD_TERM = (
    "previous|prior|friday|monday|thursday|wednesday|tuesday|close|high|low|open"
    "|^pd[hlco]$|^pw[hlco]$|^pm[hlco]$|^pm[hl]c$|^[hl]com$|^bw[hl]$"
)
#: Bucket limits of tick and of basis-point distances.
TICK_LIMITS = (1, 2, 4, 10, 40, 200, 1000)
BPS_LIMITS = (1, 5, 20, 100, 500)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def price(text: Column | str) -> Column:
    """A price as text to double: commas and dollar signs go; anything but a plain number is null."""
    clean = F.trim(F.translate(col(text), ",$", ""))
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def ticks(value: Column | str, tick: float = TICK) -> Column:
    """A price to whole ticks (half-even); null off the grid: no bar has such a price."""
    q = col(value) / F.lit(tick)
    return F.when(F.abs(q - F.rint(q)) < 1e-6, F.rint(q).cast("bigint"))


def nearest_ticks(value: Column | str, tick: float = TICK) -> Column:
    """A price to the nearest whole tick (half-even)."""
    return F.rint(col(value) / F.lit(tick)).cast("bigint")


def points(n: Column | str, tick: float = TICK) -> Column:
    return col(n) * F.lit(tick)


def fixed_point(value: Column | str, scale: int = 1_000_000_000) -> Column:
    """Integer fixed-point prices (1e-9 by default) to double."""
    return col(value) / F.lit(scale)


def bps(a: Column | str, b: Column | str) -> Column:
    """Distance in basis points of the larger magnitude; 0 where both are 0."""
    scale = F.greatest(F.abs(col(a)), F.abs(col(b)))
    return F.when(scale == 0, 0.0).otherwise(F.abs(col(a) - col(b)) / scale * 10_000)


def symbol(raw: Column | str) -> Column:
    """Whatever a chart header says to a symbol: suffixes go one after the other, then phrases, then whole tokens, else as it is."""
    s = F.upper(F.trim(col(raw)))
    for suffix in ("1!", "!", ".C.0"):
        s = F.when(F.endswith(s, F.lit(suffix)), F.substr(s, F.lit(1), F.char_length(s) - len(suffix))).otherwise(s)
    s = F.trim(s)
    tokens = F.regexp_extract_all(s, F.lit("[A-Z0-9&]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in TICKERS.items() for x in pair])
    found = F.try_element_at(F.filter(F.transform(tokens, lambda t: known[t]), lambda x: x.isNotNull()), F.lit(1))
    out = None
    for needles, name in PHRASES:
        hit = F.contains(s, F.lit(needles[0]))
        for needle in needles[1:]:
            hit |= F.contains(s, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.coalesce(found, s))


def label_class(label: Column | str) -> Column:
    """unlabelled, method_term or other."""
    s = F.trim(F.coalesce(col(label), F.lit("")))
    return F.when(s == "", "unlabelled").when(s.rlike(f"(?i){METHOD_TERM}"), "method_term").otherwise("other")


def clock(seconds: Column | str, mark: str = ":") -> Column:
    """Seconds to hh:mm:ss; negative is 0, fractions are cut."""
    s = F.greatest(F.lit(0).cast("bigint"), col(seconds).cast("bigint"))
    return F.format_string(mark.join(["%02d"] * 3), F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def spoken(seconds: Column | str) -> Column:
    """Seconds to 1h02m."""
    s = F.greatest(F.lit(0).cast("bigint"), col(seconds).cast("bigint"))
    return F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
