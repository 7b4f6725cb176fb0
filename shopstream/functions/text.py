"""Text renderings of numbers and times, as built-in column expressions.

Two renderings must agree digit for digit with other runtimes:

* ``with_py_float_text`` - the text Python gives for a float (``str(x)``),
  used in the live-feed subtitle.  The JVM's own double-to-text differs
  (``1.349E7`` for ``13490000.0``; and Java 17 sometimes prints more digits
  than the shortest form), so it is rebuilt from the shortest round-trip.
* ``js_fixed1`` - JavaScript's ``x.toFixed(1)``, which rounds the *exact
  binary value* of the double half-up.  Rounding the shortest decimal text
  instead gets ties such as 1.15 wrong (1.15 is stored below 1.15), so the
  tie is decided exactly with a Veltkamp split, in plain double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import CURRENCY_SIGN, FEED_TIME_LABEL

_SCI = r"^(-?)(\d)\.?(\d*)e([-+]\d+)$"


def with_py_float_text(df: DataFrame, src: str, out: str) -> DataFrame:
    """Adds ``out`` = Python's ``str(float)`` of column ``src``.

    Python prints the shortest digit string that reads back as the same
    double.  Step 1 picks, per row, the shortest ``%.Ne`` rendering that
    round-trips (1 to 17 significant digits); step 2 splits it into sign,
    digits and exponent; step 3 lays it out as Python does (plain notation
    for 1e-4 <= |x| < 1e16, else ``1.5e-05``).  The steps are separate
    projections so each stays small enough for whole-stage codegen.
    """
    x = F.col(src)
    shortest = None
    for p in range(1, 18):
        cand = F.format_string(f"%.{p - 1}e", x)
        ok = cand.try_cast("double") == x
        shortest = F.when(ok, cand) if shortest is None else shortest.when(ok, cand)
    step1 = df.withColumn("_pf_sci", shortest.otherwise(F.format_string("%.16e", x)))
    sci = F.col("_pf_sci")
    step2 = (step1
             .withColumn("_pf_sign", F.regexp_extract(sci, _SCI, 1))
             .withColumn("_pf_digits", F.regexp_replace(
                 F.concat(F.regexp_extract(sci, _SCI, 2), F.regexp_extract(sci, _SCI, 3)), "(?<=.)0+$", ""))
             .withColumn("_pf_exp", F.regexp_extract(sci, _SCI, 4).try_cast("int")))
    sign, digits, exp = F.col("_pf_sign"), F.col("_pf_digits"), F.col("_pf_exp")
    n = F.length(digits)
    plain_pos = F.when(
        n <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - n), F.lit(".0")),
    ).otherwise(F.concat(digits.substr(F.lit(1), exp + 1), F.lit("."), digits.substr(exp + 2, F.lit(400))))
    plain_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    tail = digits.substr(F.lit(2), F.lit(400))
    exp_text = F.abs(exp).cast("string")
    sci_out = F.concat(
        digits.substr(F.lit(1), F.lit(1)),
        F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(F.lit("")),
        F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.length(exp_text) < 2, F.concat(F.lit("0"), exp_text)).otherwise(exp_text),
    )
    body = (F.when((exp >= 0) & (exp < 16), plain_pos)
            .when((exp < 0) & (exp >= -4), plain_neg)
            .otherwise(sci_out))
    text = (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when(x == 0, x.cast("string"))
            .otherwise(F.concat(sign, body)))
    return step2.withColumn(out, text).drop("_pf_sci", "_pf_sign", "_pf_digits", "_pf_exp")


def js_fixed1(x: Column) -> Column:
    """JavaScript ``x.toFixed(1)``.

    Exact for |x| < 1e15 (any money or count this library renders); beyond
    that the digits come from the JVM's ``%.1f``.  NaN and infinities print
    as JavaScript does.
    """
    a = F.abs(x)
    safe = F.when(a < 1e15, a).otherwise(F.lit(0.0))   # keeps the integer steps in range
    n0 = F.floor(safe * 10)
    c = safe * F.lit(134217729.0)          # 2**27 + 1: Veltkamp split constant
    hi = c - (c - safe)
    lo = safe - hi
    # sign(a*20 - (2*n0 + 1)), exactly: hi*20 and lo*20 are exact products,
    # the first difference is exact (Sterbenz), the final sum keeps its sign.
    tie_side = (hi * 20 - (n0 * 2 + 1)) + lo * 20
    n = (n0 + F.when(tie_side >= 0, 1).otherwise(0)).cast("bigint")
    body = F.concat((n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(x == float("inf"), F.lit("Infinity"))
            .when(x == float("-inf"), F.lit("-Infinity"))
            .when(a >= 1e15, F.format_string("%.1f", x))
            .otherwise(F.concat(sign, body)))


def compact_count(x: Column) -> Column:
    """``1234 -> '1.2k'``, ``999 -> '999'`` (values >= 1000 in thousands)."""
    return F.when(x >= 1000, F.concat(js_fixed1(x.cast("double") / 1000), F.lit("k"))).otherwise(
        x.cast("bigint").cast("string"))


def currency_k(x: Column) -> Column:
    """Revenue card text: rupee sign, thousands, one decimal, 'k'."""
    return F.concat(F.lit(CURRENCY_SIGN), js_fixed1(x.cast("double") / 1000), F.lit("k"))


def grouped_int(x: Column) -> Column:
    """English digit grouping, ``2840 -> '2,840'``."""
    return F.format_number(x.cast("bigint"), 0)


def clock_label(ts: Column) -> Column:
    """``HH:MM:SS`` of a timestamp, zero padded."""
    return F.date_format(ts, "HH:mm:ss")


def age_label(ts: Column, as_of: Column) -> Column:
    """Relative feed age: 'Just now' under a minute, then 'Nm ago', 'Nh ago', 'Nd ago'.

    Elapsed whole seconds via ``timestampdiff``, which needs no time zone for
    TIMESTAMP_NTZ (no daylight-saving jumps).
    """
    secs = F.timestamp_diff("SECOND", ts, as_of)
    return (F.when(secs < 60, F.lit(FEED_TIME_LABEL))
            .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
            .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(secs / 86400).cast("string"), F.lit("d ago"))))
