"""Generic envelope rows -> columns of a known table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_fields as J
from ..functions.timestamps import parse_lenient_timestamp


def context_columns(df: DataFrame) -> DataFrame:
    """Add ``origin_system`` and ``destination_system`` from the envelope."""
    return df.withColumns({"origin_system": F.col("origin"), "destination_system": F.col("destination")})


def _column_value(fields: Column, name: str, kind: T.DataType) -> Column:
    value = F.try_element_at(fields, F.lit(name.lower()))
    if isinstance(kind, T.StringType):
        # nested values are stored as their JSON text; numbers of the text 1e3 count as 1000.0 does
        reprinted = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY|DOUBLE)")
        again = F.try_parse_json(F.when(reprinted, F.to_json(value)))
        return F.when(reprinted, F.try_variant_get(again, "$", "string")).otherwise(F.try_variant_get(value, "$", "string"))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return parse_lenient_timestamp(F.try_variant_get(value, "$", "string")).cast(kind)
    return F.try_variant_get(value, "$", kind.simpleString())


def _lowered_fields(fields: Column) -> Column:
    """The map with lower-case keys; of keys that differ in case only, the last one counts.

    Keys are sorted with their places, so equal ones are neighbours and no key looks at all others.
    The arguments of the outer functions are computed once per row.
    """
    placed = F.array_sort(F.transform(F.map_keys(fields), lambda k, i: F.struct(F.lower(k).alias("k"), i.alias("i"))))
    last = lambda all_: F.filter(all_, lambda x, j: ~F.coalesce(F.get(all_, j + 1)["k"] == x["k"], F.lit(False)))
    kept = F.transform(F.array(placed), last)[0]
    both = F.transform(
        F.array(F.struct(kept.alias("kept"), F.map_values(fields).alias("values"))),
        lambda b: F.map_from_arrays(F.transform(b["kept"], lambda x: x["k"]), F.transform(b["kept"], lambda x: F.get(b["values"], x["i"]))),
    )
    return both[0]


def generic_project(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``schema`` out of the ``data`` object.

    Names are matched in lower case, absent columns are NULL, unknown keys are
    dropped and generated columns are left out.
    """
    names = {f.name.lower() for f in schema.fields}
    context = {c: F.col(c) for c in ("origin_system", "destination_system") if c in names and c in df.columns}
    rows = df.withColumn("_fields", _lowered_fields(F.try_variant_get("data", "$", "map<string,variant>")))
    columns = [
        context[f.name.lower()].cast(f.dataType).alias(f.name)
        if f.name.lower() in context
        else _column_value(F.col("_fields"), f.name, f.dataType).alias(f.name)
        for f in schema.fields
        if not (f.metadata or {}).get("auto_inc")
    ]
    return rows.select(*keep, *columns)


def infer_tags(df: DataFrame) -> DataFrame:
    """One row per field of ``data`` with its kind and text."""
    entries = F.map_entries(F.from_json(F.to_json("data"), "map<string,variant>"))
    rows = df.select(*[c for c in df.columns if c != "data"], F.explode(entries).alias("_e"))
    value = F.col("_e.value")
    return rows.select(
        *[c for c in df.columns if c != "data"],
        F.col("_e.key").alias("field"),
        J.column_tag(value).alias("tag"),
        F.when(J.column_tag(value) != "null", F.to_json(value)).alias("value_json"),
    )


def unknown_table_error(table: Column, known: list[str]) -> Column:
    return F.when(
        ~F.lower(table).isin(*[k.lower() for k in known]), F.concat(F.lit("unknown table '"), table, F.lit("'"))
    )
