"""Attribute expressions: JSON arrays in prefix form, compiled once on the driver to a ``Column``.

Arithmetic takes both sides as numbers; whatever fails (null, missing, no number, division by zero, too few operands) gives the
default of the outermost call, and null in nested calls. Nulls are the text ``None`` in string operators. Python's number grammar
holds, so ``try_cast`` is guarded by it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geojobs.functions import geometry

NUMBER = r"^\s*[+-]?((\d(_?\d)*)?\.?\d(_?\d)*\.?|\d(_?\d)*\.)([eE][+-]?\d(_?\d)*)?\s*$|^\s*[+-]?(?i:inf(inity)?|nan)\s*$"


def to_number(value: Column, kind: T.DataType | None = None) -> Column:
    """The double that Python's ``float`` makes of a value, else null."""
    if kind is not None and isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    text = value.cast("string")
    plain = F.translate(F.trim(text), "_", "")
    spelled = F.lower(plain)
    special = F.when(spelled.rlike("^[+]?(inf|infinity)$"), F.lit(float("inf"))).when(spelled.rlike("^-(inf|infinity)$"), F.lit(float("-inf"))).when(spelled.rlike("^[+-]?nan$"), F.lit(float("nan")))
    return F.when(text.rlike(NUMBER), F.coalesce(special, plain.try_cast("double")))


def to_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


class _Compiled:
    """A column with its Spark type, or a literal known on the driver."""

    def __init__(self, column: Column, kind: T.DataType, constant: Any = None, is_constant: bool = False):
        self.column, self.kind, self.constant, self.is_constant = column, kind, constant, is_constant


def _literal(kind: str, value: Any) -> _Compiled:
    if value is None:
        return _Compiled(F.lit(None).cast("string"), T.StringType(), None, True)
    if kind == "string":
        return _Compiled(F.lit(str(value)), T.StringType(), str(value), True)
    if kind == "number":
        try:
            number = float(value)
        except (TypeError, ValueError):
            return _Compiled(F.lit(None).cast("double"), T.DoubleType(), None, False)
        return _Compiled(F.lit(number), T.DoubleType(), number, True)
    if isinstance(value, bool):
        return _Compiled(F.lit(value), T.BooleanType(), value, True)
    if isinstance(value, (int, float)):
        return _Compiled(F.lit(float(value)) if isinstance(value, float) else F.lit(value), T.DoubleType() if isinstance(value, float) else T.LongType(), value, True)
    return _Compiled(F.lit(str(value)), T.StringType(), str(value), True)


def _property(name: _Compiled, schema: T.StructType) -> _Compiled:
    fields = {f.name: f for f in schema.fields}
    if name.is_constant:
        key = "None" if name.constant is None else str(name.constant)
        if key in fields:
            return _Compiled(F.col(f"`{key}`"), fields[key].dataType)
        return _Compiled(F.lit(None).cast("string"), T.StringType())
    plain = [f for f in schema.fields if isinstance(f.dataType, T.AtomicType)]
    if not plain:
        return _Compiled(F.lit(None).cast("string"), T.StringType())
    lookup = F.create_map(*[x for f in plain for x in (F.lit(f.name), F.col(f"`{f.name}`").cast("string"))])
    return _Compiled(F.try_element_at(lookup, name.column), T.StringType())


def _compile(kind: str, value: Any, schema: T.StructType | None, geom: Column | None) -> tuple[_Compiled, Column | None]:
    """The value, and where it fails (None: it can't)."""
    if not isinstance(value, list):
        return _literal(kind, value), F.lit(True) if kind == "number" and value is not None and _literal(kind, value).constant is None else None
    if not value:
        return _Compiled(F.lit(None).cast("string"), T.StringType()), F.lit(True)
    op, args = value[0], value[1:]

    def arg(i: int, inner: str) -> _Compiled | None:
        if i >= len(args):
            return None
        made, failed = _compile(inner, args[i], schema, geom)
        if failed is None:
            return made
        if not isinstance(args[i], list):
            return _Compiled(F.lit(None).cast("string"), T.StringType(), None, False)
        return _Compiled(F.when(~F.coalesce(failed, F.lit(True)), made.column), made.kind)

    if op in ("+", "-", "*", "/"):
        a, b = arg(0, kind), arg(1, kind)
        if a is None or b is None:
            return _Compiled(F.lit(None).cast("double"), T.DoubleType()), F.lit(True)
        x, y = to_number(a.column, a.kind), to_number(b.column, b.kind)
        out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else F.try_divide(x, y)
        return _Compiled(out, T.DoubleType()), out.isNull()
    if op == "concat":
        a, b = arg(0, kind), arg(1, kind)
        if a is None or b is None:
            return _Compiled(F.lit(None).cast("string"), T.StringType()), F.lit(True)
        known = a.is_constant and b.is_constant
        return _Compiled(F.concat(to_text(a.column), to_text(b.column)), T.StringType(), f"{a.constant}{b.constant}" if known else None, known), None
    if op in ("lowercase", "uppercase"):
        a = arg(0, kind)
        if a is None:
            return _Compiled(F.lit(None).cast("string"), T.StringType()), F.lit(True)
        fn, py = (F.lower, str.lower) if op == "lowercase" else (F.upper, str.upper)
        return _Compiled(fn(to_text(a.column)), T.StringType(), py(str(a.constant)) if a.is_constant else None, a.is_constant), None
    if op == "property":
        a = arg(0, "")
        if a is None or schema is None:
            return _Compiled(F.lit(None).cast("string"), T.StringType()), F.lit(True)
        return _property(a, schema), None
    if op == "func":
        a = arg(0, "")
        name = a.constant if a is not None and a.is_constant else None
        if name in ("$minZ", "$maxZ") and geom is not None:
            low, high = geometry.min_max_z(geom)
            return _Compiled(low if name == "$minZ" else high, T.DoubleType()), None
        return _Compiled(F.lit(None).cast("double"), T.DoubleType()), None if a is not None else F.lit(True)
    return _Compiled(F.lit(None).cast("string"), T.StringType()), None


def compile_expression(kind: str, value: Any, schema: T.StructType | None = None, geom: Column | None = None, default: Any = None) -> Column:
    """``value`` as a column: doubles from arithmetic and numbers, strings from string operators, properties as they are.

    ``schema`` has the properties that ``["property", name]`` finds; None stands for a feature without any, where it fails.
    """
    made, failed = _compile(kind, value, schema, geom)
    if failed is None:
        return made.column
    fallback = F.lit(None) if default is None else F.lit(float(default) if kind == "number" else default)
    return F.when(F.coalesce(failed, F.lit(True)), fallback).otherwise(made.column)
