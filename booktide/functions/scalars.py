"""Scalar functions as Column expressions: exact prices, odds, expected value, time, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a day, the scale of prices, the outlier margin of the agreement flag in tenths of a thousand.
DAY_MS, SCALE, OUTLIER_E4 = 86_400_000, 10_000, 800


def epoch_ms(ts: Column) -> Column:
    """UTC milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts).cast("long")


def _on_grid(text: Column) -> Column:
    """A number's text times 10,000 where it is a whole number, at any length of the text; else null."""
    exact = text.try_cast("decimal(38,18)")
    scaled = exact * SCALE
    fine = F.rlike(text, F.lit(r"\.[0-9]{4}[0-9]*[1-9]"))  # a digit that counts after the fourth
    return F.when((scaled == F.floor(scaled)) & ~fine, scaled)


def price_e4(text: Column) -> Column:
    """A price text in [0, 1] times 10,000; null unless it lies on that grid exactly."""
    scaled = _on_grid(text)
    return F.when((scaled >= 0) & (scaled <= SCALE), scaled.cast("int"))


def e4(text: Column) -> Column:
    """The same grid without bounds."""
    return _on_grid(text).cast("int")


def whole_cents(qty: Column, cents: Column) -> Column:
    """Payout in cents of a quantity at so many cents each; null unless it is whole."""
    total = qty.cast("decimal(28,9)") * cents.cast("decimal(9,0)")
    return F.when(total == F.floor(total), total.cast("long"))


def complement(p: Column) -> Column:
    """The other side's price on the e4 grid."""
    return SCALE - p


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps, of which the smaller number's bits times 1.5 are enough."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.nullif(s.y, F.lit(0))).alias("y")))
    steps = F.ceil(F.log2(F.least(F.abs(a), F.abs(b)).cast("double") + 1) * 1.5).cast("int") + 2
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s.x)


def _div(a: Column, b: Column) -> Column:
    """Division of whole numbers, exact beyond the doubles."""
    return F.call_function("div", a, b)


def reduced(num: Column, den: Column) -> Column:
    """struct(num, den) in lowest terms, den positive; null if either is null."""
    own = F.struct(num.cast("long").alias("n"), den.cast("long").alias("d"), (F.greatest(gcd(num, den), F.lit(1)) * F.when(den < 0, -1).otherwise(1)).alias("g"))
    made = F.transform(F.array(own), lambda v: F.struct(_div(v.n, v.g).alias("num"), _div(v.d, v.g).alias("den")))
    return F.when(num.isNotNull() & den.isNotNull(), made[0])


def rational(num: Column, den: Column) -> Column:
    """The same for decimals of up to 38 digits, whose lowest terms fit a long; null if either is null. Numbers of 62 bits are reduced as longs."""
    wide, limit = "decimal(38,0)", 1 << 62
    n, d = num.cast(wide), den.cast(wide)
    small = (F.abs(n) < limit) & (F.abs(d) < limit)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.abs(d).cast("double") + 1) * 1.5).cast("int") + 2)  # Euclid takes fewer
    zero = F.lit(0).cast(wide)
    start = F.struct(F.abs(n).cast(wide).alias("x"), F.abs(d).cast(wide).alias("y"))
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.nullif(s.y, zero)).cast(wide).alias("y")))
    g = F.when(small, gcd(n.try_cast("long"), d.try_cast("long")).cast(wide)).otherwise(F.aggregate(steps, start, step, lambda s: s.x))
    made = F.transform(F.array(F.struct(n.alias("n"), d.alias("d"), F.greatest(g, F.lit(1).cast(wide)).alias("g"))), lambda v: F.struct(_div(v.n, v.g).cast("long").alias("num"), _div(v.d, v.g).cast("long").alias("den")))
    return F.when(num.isNotNull() & den.isNotNull(), made[0])


def american_odds(a: Column) -> Column:
    """Decimal odds of integer American odds as struct(num, den), reduced; null when |a| < 100."""
    ok = F.abs(a) >= 100
    return F.when(ok & (a > 0), reduced(a + 100, F.lit(100))).when(ok, reduced(F.abs(a) + 100, F.abs(a)))


def devig(d: Column, other: Column) -> Column:
    """Two-way proportional share of the side priced d."""
    return other / (d + other)


def overround(d: Column, other: Column) -> Column:
    return 1 / d + 1 / other - 1


def closing_ev(p_close: Column, d: Column) -> Column:
    """Expected value of decimal odds d at the closing price."""
    return p_close * d - 1


def null_ev(p_ref: Column, d: Column) -> Column:
    """Expected value of decimal odds d at the reference's price when the entry was decided."""
    return p_ref * d - 1


def residual(p_close: Column, p_ref: Column, d: Column) -> Column:
    """What the reference moved after the entry, at its odds."""
    return (p_close - p_ref) * d


def agreement(q_e4: Column, p_e4: Column) -> Column:
    """1 if an entry's and a reference's shares are more than 8 points apart."""
    return F.when(q_e4.isNull(), None).when(p_e4.isNull(), None).otherwise((F.abs(q_e4 - p_e4) > OUTLIER_E4).cast("int"))


def agreement_reason(q: Column, p: Column) -> Column:
    """Why the agreement flag is unknown; null if it is known."""
    return ladder([(q.isNull(), "no_opposite_quote"), (p.isNull(), "no_reference_at_entry")])


def spread_e4(bid_e4: Column, ask_e4: Column) -> Column:
    return ask_e4 - bid_e4


def eastern_day(ms: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), "America/New_York").cast("date")


def iso_ms(text: Column) -> Column:
    """UTC milliseconds of an ISO time, rounded to the nearest one (halves to the even one)."""
    return F.bround(F.unix_micros(F.to_timestamp(text)).cast("decimal(20,0)") / 1000).cast("long")


def ms_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ladder(pairs: list[tuple[Column, str]], last: str | None = None) -> Column:
    """The first reason whose predicate holds."""
    out = None
    for test, reason in pairs:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out.otherwise(F.lit(last))


def citation(relpath: Column, line: Column) -> Column:
    return F.concat(relpath, F.lit("#"), line.cast("string"))


def redacted(url: Column) -> Column:
    """A URL without the values of query parameters that carry secrets."""
    return F.regexp_replace(url, r"(?i)([?&](?:api_?key|token|secret|signature)=)[^&#]*", "$1REDACTED")


def fair_grade(text: Column) -> Column:
    """Whether a settlement value is a share from 0 to 1."""
    return F.rlike(text, F.lit(r"^(0(\.[0-9]+)?|1(\.0+)?)$"))


def header(headers: Column, name: str) -> Column:
    """The first header of that name, in any case, of array<array<string>>."""
    return F.get(F.get(F.filter(headers, lambda h: F.lower(h[0]) == name.lower()), F.lit(0)), F.lit(1))
