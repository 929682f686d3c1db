import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.errors import GraphError
from weftline.functions import stdlib
from weftline.functions.predicates import compare, like
from weftline.functions.stdlib import Value


def run(spark, name, *args):
    def value(a):
        if isinstance(a, set | frozenset | tuple):
            return Value(F.array(*[F.lit(x) for x in a]), "set")
        if isinstance(a, list):
            return Value(F.array(*[F.lit(x) for x in a]), "array")
        return Value(F.lit(a))

    return spark.range(1).select(stdlib.call(name, [value(a) for a in args]).col.alias("v")).first()[0]


def test_there_are_41():
    assert len(stdlib.FUNCTIONS) == 41


@pytest.mark.parametrize(
    ("name", "args", "expected"),
    [
        ("math::abs", (-42.5,), 42.5),
        ("math::abs", ((-1, 2, -3),), [1, 2, 3]),
        ("math::ceil", (1.2,), 2),
        ("math::floor", (-1.2,), -2),
        ("math::exp", (1.0,), math.e),
        ("math::ln", (0.0,), None),
        ("math::ln", (-1.0,), None),
        ("math::lg", (100.0,), 2.0),
        ("math::log", (8.0, 2.0), 3.0),
        ("math::log", (8.0, 1.0), None),
        ("math::acos", (2.0,), None),
        ("math::asin", (1.0,), math.pi / 2),
        ("math::cot", (0.0,), None),
        ("math::cot", (1.0,), 1 / math.tan(1)),
        ("math::atan2", (1.0, 2.0), math.atan2(1, 2)),
        ("math::mean", ((1, 3, 5),), 3.0),
        ("math::mean", ([1, 2],), 1.5),
        ("math::stddev", ((1,),), None),
        ("math::var_pop", ((1, 3, 5),), 8 / 3),
        ("math::sin", ([0.5, 9.0],), math.sin(0.5)),
        ("std::to_str", (None,), None),
        ("std::to_str", (-42.5,), "-42.5"),
        ("std::to_datetime", ("2024-02-03T04:05:06.789Z",), "2024-02-03T04:05:06.789Z"),
        ("std::datetime_get", ("2024-02-03T04:05:06Z", "epochseconds"), 1706933106),
        ("std::datetime_get", ("2024-02-03T04:05:06Z", "HOUR"), 4),
        ("std::datetime_get", ("2024-02-03T04:05:06Z", "week"), None),
        ("std::datetime_truncate", ("day", "2024-02-03T04:05:06.5Z"), "2024-02-03T00:00:00.000Z"),
        ("std::datetime_truncate", ("eon", "2024-02-03T04:05:06.5Z"), "2024-02-03T04:05:06.500Z"),
        ("cal::date_get", ("2024-02-03", "month"), 2),
        ("cal::time_get", ("04:05", "second"), 0),
        ("cal::to_local_time", ("23:59:59.123456",), "23:59:59.123456"),
        ("std::duration_get", ("P3DT4H", "hours"), 4),
        ("std::duration_get", ("P3D", "minutes"), 0),
        ("std::duration_truncate", ("seconds", "PT1H2M3S"), "PT1H2M3S"),
        ("cal::duration_normalize_hours", ("PT49H125M9S",), "PT51H5M9S"),
        ("cal::duration_normalize_days", ("PT49H125M9S",), "P2DT1H125M9S"),
        ("cal::to_date_duration", ("-P3D",), "-P3D"),
        ("pi", (), math.pi),
    ],
)
def test_values(spark, name, args, expected):
    got = run(spark, name, *args)
    assert got == pytest.approx(expected) if expected is not None else got is None


@pytest.mark.parametrize(
    ("name", "args"),
    [
        ("cal::to_local_date", ("2024-02-30",)),
        ("cal::to_local_time", ("24:00",)),
        ("cal::to_local_datetime", ("2024-02-03 04:05",)),
        ("std::to_duration", ("3 hours",)),
        ("std::to_datetime", ("never",)),
        ("std::duration_get", ("PT1.5H", "hours")),
        ("cal::date_get", ("2024", "year")),
    ],
)
def test_bad_text_is_an_error(spark, name, args):
    with pytest.raises(Exception, match="Invalid"):
        run(spark, name, *args)


def test_arity_and_names():
    with pytest.raises(GraphError, match="argument"):
        stdlib.call("math::abs", [])
    with pytest.raises(GraphError, match="does not exist"):
        stdlib.call("math::nothing", [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), min_size=2, max_size=6))
def test_moments(spark, xs):
    assert run(spark, "math::stddev", tuple(xs)) == pytest.approx(statistics.stdev(xs))
    assert run(spark, "math::var_pop", tuple(xs)) == pytest.approx(statistics.pvariance(xs))


def plain_like(text, pattern):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    text, pattern = fold(text), fold(pattern)
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(plain_like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    return bool(text) and pattern[0] in ("_", text[0]) and plain_like(text[1:], pattern[1:])


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("aBbÉé%_\\", max_size=5), st.lists(st.text("AaBbÉé\\", max_size=5), max_size=5))
def test_like(spark, pattern, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, ""]], "t string").select("t", like(F.col("t"), pattern).alias("hit")).collect()
    assert all(r.hit == plain_like(r.t, pattern) for r in rows)


def test_three_valued_logic(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    hits = lambda op, v: sorted(r.x for r in rows.where(compare(F.col("x"), op, v)).collect())
    assert hits("=", 1) == [1] and hits("!=", 1) == [2] and hits("=", None) == [] and hits("!=", None) == []
    assert hits("in", ()) == [] and hits("in", (1, 2)) == [1, 2] and hits("not in", (1,)) == [2]
    assert rows.where(compare(F.col("x"), "not in", ())).count() == 3
