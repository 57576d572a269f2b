"""Random expression trees against a plain evaluator of the same rules."""

import random
import re

from pyspark.sql import types as T

from geojobs.functions.expr import NUMBER, compile_expression

SCHEMA = T.StructType([T.StructField("gid", T.LongType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("i", T.LongType())])
ROWS = [(1, 2.5, "7", 3), (2, None, "abc", 0), (3, 0.0, None, None), (4, -1.0, " 1e2 ", 5), (5, 4.0, "1.0d", 1)]


class Fails(Exception):
    pass


def number(v):
    if v is None:
        raise Fails
    try:
        return float(v)
    except ValueError:
        raise Fails from None


def evaluate(kind, value, feature, default=None):
    """One value by the rules of the expression language."""
    if not isinstance(value, list):
        if value is None:
            return None
        return str(value) if kind == "string" else float(value) if kind == "number" else value
    if not value:
        return default
    op, args = value[0], value[1:]
    try:
        inner = "" if op in ("property", "func") else kind
        got = [evaluate(inner, a, feature) for a in args]
        if op in "+-*/":
            a, b = number(got[0]), number(got[1])
            if op == "/" and b == 0:
                raise Fails
            return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b
        if op == "concat":
            return f"{got[0]}{got[1]}"
        if op in ("lowercase", "uppercase"):
            return f"{got[0]}".lower() if op == "lowercase" else f"{got[0]}".upper()
        if op == "property":
            return feature.get(got[0])
        return None
    except (Fails, IndexError):
        return default


def tree(rng, depth, kind):
    if depth == 0:
        return rng.choice([1, 2.5, 0, None]) if kind == "number" else rng.choice(["a", "B", None])
    op = rng.choice(["+", "-", "*", "/", "property"] if kind == "number" else ["concat", "lowercase", "uppercase", "property"])
    if op == "property":
        return ["property", rng.choice(["n", "i", "absent"] if kind == "number" else ["s", "absent"])]
    if op in ("lowercase", "uppercase"):
        return [op, tree(rng, depth - 1, kind)]
    return [op, tree(rng, depth - 1, kind), tree(rng, depth - 1, kind)]


def test_random_trees(spark):
    rng = random.Random(5)
    cases = [(kind, tree(rng, rng.randint(1, 3), kind), 9) for kind in ("number", "string") for _ in range(25)]
    cases = [(k, v, 9 if k == "number" else "none") for k, v, _ in cases if isinstance(v, list)]
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.select("gid", *[compile_expression(k, v, SCHEMA, None, d).alias(f"c{i}") for i, (k, v, d) in enumerate(cases)]).orderBy("gid").collect()
    for row, feature in zip(got, ROWS):
        named = dict(zip(("gid", "n", "s", "i"), feature))
        for i, (k, v, d) in enumerate(cases):
            want = evaluate(k, v, named, d)
            have = row[f"c{i}"]
            assert have == want or have is not None and want is not None and str(have) == str(want) or k == "number" and want is not None and abs(float(have) - float(want)) < 1e-9, (v, named, have, want)


def test_number_grammar():
    for text in ("1", " 1.5 ", "1e3", "+.5", "1.", "inf", "-Infinity", "nan", "1_000"):
        assert re.match(NUMBER, text), text
        float(text)
    for text in ("", "abc", "1.0d", "1__0", "e5", "."):
        assert not re.match(NUMBER, text), text
