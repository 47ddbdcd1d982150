"""Typed access to the fields of one JSON row held in a VARIANT column.

A field of the wrong JSON type counts as absent: Spark's own casts would turn a
number into a string or ``true`` into 1, so each accessor checks the stored type
first.  ``row`` is the VARIANT column, ``path`` a dotted key path such as
``host`` or ``metrics.risk_score``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import parse_offset_timestamp


def parse_json(text: Column | str) -> Column:
    """VARIANT value of a JSON text, NULL when it is not JSON."""
    return F.try_parse_json(text)


def with_parsed(df, text: Column, name: str = "_v"):
    """Add the VARIANT of a JSON text as a generated column.

    A plain column would be copied into every filter that Spark moves below it,
    and the text parsed once per copy; a generator's output is computed once.
    """
    return df.select("*", F.explode(F.array(parse_json(text))).alias(name))


class Members(dict):
    """The members of a row as separate VARIANT columns, named on first use.

    Reading many fields out of one VARIANT looks each of them up again.  A
    ``Members`` object can stand for the row in every accessor below; afterwards
    ``split`` cuts the members that were used out of the row in one pass.
    """

    def __missing__(self, key: str) -> Column:
        self[key] = F.col(f"_m_{key}")
        return self[key]

    def split(self, df, row: Column):
        """Add the used members of ``row`` as columns; all NULL when it is not an object."""
        kind = "struct<" + ", ".join(f"_m_{k}: variant" for k in self) + ">"
        # the cast matches by member name, so cut with the plain names and rename
        plain = F.try_variant_get(row, "$", kind.replace("_m_", ""))
        return df.select("*", F.inline(F.array(plain)).alias(*[f"_m_{k}" for k in self]))


def _get(row: Column | Members, path: str, kind: str) -> Column:
    if isinstance(row, Members):
        top, _, rest = path.partition(".")
        return F.try_variant_get(row[top], f"$.{rest}" if rest else "$", kind)
    return F.try_variant_get(row, f"$.{path}", kind)


def field(row: Column | Members, path: str) -> Column:
    if isinstance(row, Members) and "." not in path:
        return row[path]
    return _get(row, path, "variant")


def json_type(row: Column | Members, path: str) -> Column:
    """Type name of a field (STRING, BIGINT, BOOLEAN, VOID, ARRAY<..>, ...), NULL when absent."""
    return F.schema_of_variant(field(row, path))


def is_object(value: Column) -> Column:
    """By a cast to one member, which is not null for objects only: ``schema_of_variant`` walks the whole value."""
    return F.try_variant_get(value, "$", "struct<_: variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def string_value(row: Column, path: str) -> Column:
    """The string at ``path``; NULL for other types. An empty string stays empty."""
    return F.when(json_type(row, path) == "STRING", _get(row, path, "string"))


def not_string(row: Column, path: str) -> Column:
    return F.coalesce(json_type(row, path) != "STRING", F.lit(True))


def optional_string(row: Column, path: str) -> Column:
    """The non-empty string at ``path``, else NULL."""
    return F.nullif(string_value(row, path), F.lit(""))


def optional_long(row: Column, path: str, numeric_strings: bool = True) -> Column:
    """Whole number at ``path``, else NULL.

    ``2.0`` and ``1e3`` are whole; ``1.5``, booleans and values out of the
    64-bit range are not.  ``numeric_strings`` also admits ``"12"``.
    """
    number = _get(row, path, "bigint")
    return F.when(_is_whole(row, path) & _is_number(row, path, numeric_strings), number)


def _is_whole(row: Column, path: str) -> Column:
    """The value survives a cast to bigint; that cast alone would cut a fraction off."""
    number = _get(row, path, "bigint")
    return _get(row, path, "double") == number.cast("double")


def _is_number(row: Column, path: str, numeric_strings: bool) -> Column:
    kind = json_type(row, path)
    return kind != "BOOLEAN" if numeric_strings else ~kind.isin("BOOLEAN", "STRING")


def optional_double(row: Column, path: str, numeric_strings: bool = True) -> Column:
    """Number at ``path`` as a double, else NULL."""
    real = _get(row, path, "double")
    return F.when(_is_number(row, path, numeric_strings) & ~F.isnan(real), real)


def optional_boolean(row: Column, path: str) -> Column:
    return F.when(json_type(row, path) == "BOOLEAN", _get(row, path, "boolean"))


def optional_timestamp(row: Column, path: str) -> Column:
    """UTC timestamp of an ISO-8601 text with an offset, else NULL."""
    return parse_offset_timestamp(string_value(row, path))


def bool_flag(row: Column, path: str) -> Column:
    """1 for true or a non-zero whole number, else 0."""
    truth = (_get(row, path, "bigint") != 0) & _is_whole(row, path)
    return F.coalesce(truth, F.lit(False)).cast("bigint")


def reason_flag(row: Column, path: str, reasons: list[str]) -> Column:
    """1 when the array at ``path`` holds one of ``reasons``, else 0."""
    listed = _get(row, path, "array<variant>")
    named = F.exists(
        listed,
        lambda item: (F.schema_of_variant(item) == "STRING")
        & F.coalesce(F.try_variant_get(item, "$", "string").isin(*reasons), F.lit(False)),
    )
    return F.when(F.coalesce(named, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def json_array_string(row: Column, path: str, raw: Column | None = None) -> Column:
    """Compact text of the array at ``path``, NULL for other types.

    A VARIANT holds object keys sorted.  With the row's text in ``raw``, arrays
    that contain objects are taken from the text and keep their key order.
    """
    kind = json_type(row, path)
    text = F.to_json(field(row, path))
    if raw is not None:
        text = F.when(kind.contains("OBJECT"), F.get_json_object(raw, f"$.{path}")).otherwise(text)
    return F.when(kind.startswith("ARRAY"), text)


def first_of(values: list[Column]) -> Column:
    return F.coalesce(*values)


def extract_field(text: Column, path: str) -> Column:
    """Non-empty top-level string of a JSON text; NULL for anything else."""
    return optional_string(parse_json(text), path)


def json_text_field(text: Column, path: str) -> Column:
    """Unquoted text of a field, as the SQL ``->>`` operator gives it."""
    return F.get_json_object(text, f"$.{path}")


def json_details(**values: Column) -> Column:
    """JSON object text of the non-NULL pairs, in the given order."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in values.items()]))


def column_tag(value: Column) -> Column:
    """Kind of a dynamic column value: null, str, long, decimal, double, bool or json."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "bigint")
    real = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), "null")
        .when(kind == "STRING", "str")
        .when(kind == "BIGINT", "long")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (real == whole.cast("double")), "long")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
        .when(kind == "BOOLEAN", "bool")
        .otherwise("json")
    )


# --- values paired with the error that explains their absence -----------------


def missing(kind: str, path: str, context: str) -> str:
    return f"Missing required {kind} field '{path}' in {context}"


def required_string(row: Column, path: str, context: str) -> tuple[Column, Column]:
    return string_value(row, path), F.when(not_string(row, path), F.lit(missing("string", path, context)))


def required_long(row: Column, path: str, context: str) -> tuple[Column, Column]:
    value = optional_long(row, path)
    return value, F.when(value.isNull(), F.lit(missing("long", path, context)))


def required_timestamp(row: Column, path: str, context: str) -> tuple[Column, Column]:
    text = string_value(row, path)
    value = parse_offset_timestamp(text)
    invalid = F.concat(F.lit("Invalid timestamp '"), text, F.lit(f"' for field '{path}' in {context}"))
    error = F.when(not_string(row, path), F.lit(missing("timestamp", path, context))).when(value.isNull(), invalid)
    return value, error


_ALIAS_READERS = {"timestamp": optional_timestamp, "string": optional_string, "long": optional_long}


def alias(kind: str, row: Column, primary: str, secondary: str, context: str) -> tuple[Column, Column]:
    """The primary field, else the secondary one, else an error."""
    read = _ALIAS_READERS[kind]
    value = F.coalesce(read(row, primary), read(row, secondary))
    error = F.lit(f"Missing {kind}: neither '{primary}' nor '{secondary}' in {context}")
    return value, F.when(value.isNull(), error)


def first_error(errors: list[Column]) -> Column:
    """The first error that is set, in the order given."""
    if not errors:
        return F.lit(None).cast("string")
    return reduce(lambda a, b: F.coalesce(a, b), errors)
