"""Typed values: JSON without its outer braces, read by a declared specification.

A specification is a tuple of ``Field``; it comes from the ``type_fields`` catalogue, which is as
small as the type declarations and may be collected. The values themselves stay in columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.tables import SCALAR_TYPES, spark_type


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "scalar"  # scalar, array or tuple
    type: str | None = None
    length: int | None = None
    default: str | None = None
    members: tuple[Field, ...] = ()

    def data_type(self) -> T.DataType:
        if self.kind == "tuple":
            return struct_type(self.members)
        element = spark_type(self.type)
        return T.ArrayType(element) if self.kind == "array" else element


def struct_type(spec: Sequence[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.data_type()) for f in spec])


def _nest(rows: list, prefix: str = "") -> tuple[Field, ...]:
    out = []
    for row in rows:
        inside = row["path"][len(prefix) :] if row["path"].startswith(prefix) else ""
        if not inside or "." in inside:
            continue
        members = _nest(rows, f"{row['path']}.") if row["kind"] == "tuple" else ()
        out.append(
            Field(row["name"], row["kind"], row["type"], row["length"], row["default"], members)
        )
    return tuple(out)


def specs_of(type_fields: DataFrame, section: str) -> dict[tuple[str, str | None], tuple[Field, ...]]:
    """Specification of every (owner, port) for one section; reads the small catalogue."""
    rows = type_fields.filter(F.col("section") == section).orderBy("owner", "port", "idx").collect()
    grouped: dict[tuple[str, str | None], list] = {}
    for row in rows:
        grouped.setdefault((row["owner"], row["port"]), []).append(row)
    return {key: _nest(fields) for key, fields in grouped.items()}


def merged_spec(specs: Sequence[Sequence[Field]]) -> tuple[Field, ...]:
    """Union of all fields by name; the first declaration of a name wins."""
    merged: dict[str, Field] = {}
    for spec in specs:
        for field in spec:
            merged.setdefault(field.name, field)
    return tuple(merged.values())


def braced(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("{"), F.coalesce(t, F.lit("")), F.lit("}"))


def decode(text: Column | str, spec: Sequence[Field]) -> Column:
    """Brace-less JSON text to a struct; absent members are NULL."""
    return F.from_json(braced(text), struct_type(spec))


def encode(value: Column | str) -> Column:
    """Struct to brace-less JSON text; NULL members and empty values are left out."""
    json = F.to_json(value)
    inner = F.substring(json, F.lit(2), F.length(json) - 2)
    return F.when(F.length(json) > 2, inner)


def _default_scalar(field: Field) -> Column:
    return F.lit(field.default if field.default is not None else "0").cast(spark_type(field.type))


def default_value(field: Field) -> Column:
    if field.kind == "tuple":
        return F.struct(*[default_value(m).alias(m.name) for m in field.members])
    if field.kind == "array":
        return F.array_repeat(_default_scalar(field), field.length)
    return _default_scalar(field)


def expand(value: Column, field: Field) -> Column:
    """``value`` with every missing member, element or field replaced by its default."""
    if field.kind == "tuple":
        return F.struct(*[expand(value[m.name], m).alias(m.name) for m in field.members])
    if field.kind == "array":
        filled = F.transform(value, lambda v: F.coalesce(v, _default_scalar(field)))
        return F.coalesce(filled, default_value(field))
    return F.coalesce(value, _default_scalar(field))


def expand_defaults(df: DataFrame, column: str, spec: Sequence[Field]) -> DataFrame:
    """Replace struct ``column`` by its expansion to the full specification."""
    return df.withColumn(
        column, F.struct(*[expand(F.col(column)[f.name], f).alias(f.name) for f in spec])
    )


def _scalar_fits(value: Column, type_name: str) -> Column:
    """Whether a VARIANT holds a value of the declared type; NULL values always fit.

    Integers accept any number (its fraction is dropped) and digit strings, floats any number or
    numeric string.
    """
    _, low, high = SCALAR_TYPES[type_name]
    is_text = F.schema_of_variant(value) == "STRING"
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    if low is None:
        fits = number.isNotNull() if type_name != "string" else text.isNotNull()
    else:
        whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
        digits = ~is_text | text.rlike(r"^\s*[+-]?[0-9]+\s*$")
        fits = digits & whole.between(low, high)
    absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
    return absent | F.coalesce(fits, F.lit(False))


def _fits(value: Column, text: Column, path: str, field: Field) -> Column:
    here = F.try_variant_get(value, path, "variant")
    if field.kind == "tuple":
        inner = F.get_json_object(text, path)
        return inner.isNull() | _object_fits(value, text, path, field.members)
    if field.kind == "array":
        items = F.try_variant_get(value, path, "array<variant>")
        absent = here.isNull() | (F.schema_of_variant(here) == "VOID")
        good = (F.size(items) == field.length) & F.forall(
            items, lambda v: _scalar_fits(v, field.type)
        )
        return absent | F.coalesce(good, F.lit(False))
    return _scalar_fits(here, field.type)


def _object_fits(value: Column, text: Column, path: str, spec: Sequence[Field]) -> Column:
    keys = F.json_object_keys(text if path == "$" else F.get_json_object(text, path))
    known = F.array(*[F.lit(f.name) for f in spec]) if spec else F.array().cast("array<string>")
    result = F.coalesce(F.size(F.array_except(keys, known)) == 0, F.lit(False))
    for field in spec:
        result = result & _fits(value, text, f"{path}.{field.name}", field)
    return result


def is_refinement(text: Column | str, spec: Sequence[Field]) -> Column:
    """Whether brace-less JSON text refines the specification: types, ranges, array lengths and no
    unknown member. Absent text always does; text that is not JSON never does."""
    json = braced(text)
    value = F.try_parse_json(json)
    raw = F.col(text) if isinstance(text, str) else text
    return raw.isNull() | (
        value.isNotNull() & F.coalesce(_object_fits(value, json, "$", spec), F.lit(False))
    )


def widen(df: DataFrame, spec: Sequence[Field], text: str = "props") -> DataFrame:
    """One NULL-filled column per field of the merged specification instead of the text column."""
    rest = [c for c in df.columns if c != text]
    return df.withColumn("_v", decode(text, spec)).select(*rest, "_v.*")


def field_lists(type_fields: DataFrame) -> DataFrame:
    """Per type its state and property names, sorted, arrays in brackets: ``a,b,[c]``."""
    top = type_fields.filter((F.col("owner_kind") == "device") & (F.col("name") == F.col("path")))
    shown = F.when(F.col("kind") == "array", F.concat(F.lit("["), "name", F.lit("]"))).otherwise(
        F.col("name")
    )

    def names(section: str) -> Column:
        listed = F.collect_list(F.when(F.col("section") == section, shown))
        return F.array_join(F.array_sort(listed), ",")

    return top.groupBy(F.col("owner").alias("id")).agg(
        names("state").alias("states"), names("properties").alias("properties")
    )


def format_value(value: Column, field: Field) -> Column:
    """Readable text: floats with three decimals, arrays ``[a,b]``, tuples ``{name:value}``."""
    if field.kind == "tuple":
        return format_struct(value, field.members)
    if field.kind == "array":
        return F.concat(
            F.lit("["),
            F.array_join(F.transform(value, lambda v: _format_scalar(v, field.type)), ","),
            F.lit("]"),
        )
    return _format_scalar(value, field.type)


def _format_scalar(value: Column, type_name: str) -> Column:
    if type_name in ("half", "float", "double"):
        return F.format_string("%.3f", value.cast("double"))
    return value.cast("string")


def format_struct(value: Column, spec: Sequence[Field]) -> Column:
    parts = [F.concat(F.lit(f"{f.name}:"), format_value(value[f.name], f)) for f in spec]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
