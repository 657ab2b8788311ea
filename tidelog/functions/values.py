"""Declared types, literals, and equality by text.

The data model compares values by their text: the number 1 equals the text '1'. A comparison with a
literal is turned into a typed predicate on the driver, so that it can still be pushed to a scan;
only joins between a number and a text column render each row.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, NumericType, StringType

TYPES: dict[str, DataType] = {"INT": DoubleType(), "FLOAT": DoubleType(), "TEXT": StringType(), "VARCHAR": StringType(), "BOOL": BooleanType()}

Literal = str | float | bool

#: Fixed value: the text of a missing value.
NIL = "<nil>"


def parse_literal(text: str) -> Literal:
    """Quoted text, then true or false, then a number, else the text as it stands. Numbers must be finite."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        number = float.fromhex(text) if text.lower().lstrip("+-").startswith("0x") else float(text.replace("_", "x"))
    except (ValueError, OverflowError):
        return text
    if not math.isfinite(number):
        raise ValueError(f"not a finite number: {text}")
    return number


def render(value: Any) -> str:
    """The text by which values are compared: shortest digits, an exponent from 1e+06 on and below 1e-04."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return NIL
    if isinstance(value, int | float):
        x = float(value)
        if math.isnan(x) or math.isinf(x):
            return "NaN" if math.isnan(x) else ("+Inf" if x > 0 else "-Inf")
        if x == 0:
            return "-0" if math.copysign(1, x) < 0 else "0"
        digits, exponent = f"{x:.16e}".split("e")
        for places in range(17):
            digits, exponent = f"{x:.{places}e}".split("e")
            if float(f"{digits}e{exponent}") == x:
                break
        if -4 <= int(exponent) < 6:
            return f"{x:.{max(0, len(digits.replace('-', '').replace('.', '')) - 1 - int(exponent))}f}"
        return f"{digits}e{int(exponent):+03d}"
    return str(value)


def to_json(value: Any) -> str:
    """A value as it is stored in an event: JSON text."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("events can't hold a number that is not finite")
    return json.dumps(value, ensure_ascii=False)


def type_matches(declared: str, value: Any) -> bool:
    """Whether a value may be stored in a column of the declared type; unknown types take anything."""
    kind = TYPES.get(declared.upper())
    if isinstance(kind, DoubleType):
        return isinstance(value, int | float) and not isinstance(value, bool)
    if isinstance(kind, StringType):
        return isinstance(value, str)
    if isinstance(kind, BooleanType):
        return isinstance(value, bool)
    return True


def equals_literal(column: Column, kind: DataType, literal: Literal) -> Column:
    """``column = literal`` by text, as a predicate of the column's own type."""
    text = render(literal)
    if isinstance(kind, StringType):
        return column == F.lit(text)
    if isinstance(kind, BooleanType):
        return column == F.lit(text == "true") if text in ("true", "false") else F.lit(False)
    if isinstance(kind, NumericType):
        try:
            number = float(text)
        except ValueError:
            return F.lit(False)
        if render(number) != text:
            return F.lit(False)
        return column == (F.lit(int(number)) if number.is_integer() and not isinstance(kind, DoubleType) else F.lit(number))
    return column.cast("string") == F.lit(text)


def render_column(column: Column, kind: DataType) -> Column:
    """``render`` of each row, for joins of a number with a text."""
    if isinstance(kind, BooleanType):
        return column.cast("string")
    if not isinstance(kind, NumericType):
        return column.cast("string")
    x = column.cast("double")
    text = x.cast("string")  # shortest digits: 1.5, 100.0, 1.0E7
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"[-.]", ""), r"^0+|0+$", "")
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    exponent = F.when(F.abs(x) >= F.pow(F.lit(10.0), exponent + 1), exponent + 1).otherwise(exponent)
    sign = F.when(x < 0, "-").otherwise("")
    more = F.when(F.length(digits) > 1, F.concat(F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise("")
    mantissa = F.concat(digits.substr(1, 1), more)
    scientific = F.concat(sign, mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    whole = x.cast("long").cast("string")
    return F.when(x == 0, "0").when((F.abs(x) < 1e6) & (x == F.floor(x)), whole).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e6), plain).otherwise(scientific)


def equals_column(left: Column, left_kind: DataType, right: Column, right_kind: DataType) -> Column:
    """``left = right`` by text: typed where both are of one family, rendered where not."""
    families = [(NumericType, StringType, BooleanType)[next((i for i, k in enumerate((NumericType, StringType, BooleanType)) if isinstance(t, k)), 1)] for t in (left_kind, right_kind)]
    if families[0] is families[1] and families[0] is not StringType:
        return left.eqNullSafe(right)
    return F.coalesce(render_column(left, left_kind), F.lit(NIL)) == F.coalesce(render_column(right, right_kind), F.lit(NIL))
