"""Number/time renderings against Python's float text and JavaScript's toFixed."""

from decimal import Decimal, ROUND_HALF_UP

from pyspark.sql import functions as F

from shopstream.functions.text import compact_count, currency_k, js_fixed1, with_py_float_text

VALUES = [0.0, -0.0, 1.0, 19.650000000000002, 0.1 + 0.2, 13490000.0, 134900.0 * 100, 1e16, 1.5e16,
          1e-4, 1.5e-5, 0.001, 123456789.125, 9999999.0, 10000000.0, -2.5e-7, 1e22, 6.55 * 3,
          float("inf"), float("-inf"), 2.0 ** 60, 5e-324, 1.7976931348623157e308]


def test_py_float_str_matches_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = [r["t"] for r in with_py_float_text(df, "x", "t").collect()]
    assert got == [str(v) for v in VALUES]


def test_py_float_text_random_doubles(spark):
    import random
    rng = random.Random(7)
    vals = [rng.uniform(-1e6, 1e6) for _ in range(300)] + [rng.random() * 10 ** rng.randint(-30, 30)
                                                           for _ in range(300)]
    vals += [round(rng.uniform(0, 600), 2) * rng.randint(1, 3) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["t"] for r in with_py_float_text(df, "x", "t").collect()]
    assert got == [str(v) for v in vals]


def js_to_fixed1(x: float) -> str:
    """JavaScript Number.prototype.toFixed(1): exact binary value, ties up."""
    sign = "-" if x < 0 else ""
    d = Decimal(abs(x)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
    return f"{sign}{d}"


FIXED = [1.15, 1.25, 1.35, 2.25, 0.05, 0.15, 0.25, 999.95, 193.56418, 10.0, 1.049999999, 1.05,
         -1.15, -2.25, 12345.65, 0.0, 7.45, 8.55, 1e12 + 0.05]


def test_js_fixed1_matches_exact_rounding(spark):
    df = spark.createDataFrame([(v,) for v in FIXED], "x double")
    got = [r[0] for r in df.select(js_fixed1(F.col("x"))).collect()]
    assert got == [js_to_fixed1(v) for v in FIXED]


def test_compact_and_currency(spark):
    df = spark.createDataFrame([(999, 1150.0), (1000, 1250.0), (10000, 193564.18)], "n long, r double")
    got = df.select(compact_count(F.col("n")), currency_k(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("999", "₹1.1k"), ("1.0k", "₹1.3k"), ("10.0k", "₹193.6k")]


def test_js_fixed1_non_finite_and_huge(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.5e15,)], "x double")
    got = [r[0] for r in df.select(js_fixed1(F.col("x"))).collect()]
    assert got == ["NaN", "Infinity", "-Infinity", "2500000000000000.0"]
