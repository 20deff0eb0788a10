"""Typed values: defaults, refinement, nesting, widening and formats."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.functions import scalars as sc
from portmesh.functions import style, typed
from portmesh.functions.typed import Field
from portmesh.tables import spark_type, storage_class

POINT = Field("pos", "tuple", members=(Field("x", type="int8_t"), Field("y", type="int16_t", default="4")))
SPEC = (
    Field("a", type="uint8_t", default="9"),
    Field("f", type="float"),
    Field("v", "array", "int16_t", length=2),
    POINT,
)


def _one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


@pytest.mark.parametrize(
    "text, fits",
    [
        (None, True), ("", True), ('"a":255', True), ('"a":256', False), ('"a":-1', False),
        ('"a":"12"', True), ('"a":"1.5"', False), ('"a":3.9', True), ('"f":"2.5"', True),
        ('"f":"x"', False), ('"v":[1,2]', True), ('"v":[1]', False), ('"v":[1,70000]', False),
        ('"v":3', False), ('"pos":{"x":127}', True), ('"pos":{"x":128}', False),
        ('"pos":{"z":1}', False), ('"nope":1', False), ('"a":null', True), ("{broken", False),
    ],
)
def test_refinement(spark, text, fits):
    assert _one(spark, text).select(typed.is_refinement("t", SPEC)).first()[0] is fits


def test_expansion_fills_every_level(spark):
    df = _one(spark, '"f":1.5,"pos":{"x":3},"v":[7,null]').select(typed.decode("t", SPEC).alias("v"))
    full = typed.expand_defaults(df, "v", SPEC).first()["v"].asDict(recursive=True)
    assert full == {"a": 9, "f": 1.5, "v": [7, 0], "pos": {"x": 3, "y": 4}}
    empty = _one(spark, None).select(typed.decode("t", SPEC).alias("v"))
    full = typed.expand_defaults(empty, "v", SPEC).first()["v"].asDict(recursive=True)
    assert full == {"a": 9, "f": 0.0, "v": [0, 0], "pos": {"x": 0, "y": 4}}


def test_encode_is_the_inverse_of_decode(spark):
    df = _one(spark, '"a":3,"v":[1,2]').select(typed.decode("t", SPEC).alias("v"))
    assert df.select(typed.encode("v")).first()[0] == '"a":3,"v":[1,2]'
    none = _one(spark, "").select(typed.decode("t", SPEC).alias("v"))
    assert none.select(typed.encode("v")).first()[0] is None


def test_format(spark):
    df = _one(spark, '"a":3,"f":2,"v":[1,2],"pos":{"x":1,"y":2}').select(typed.decode("t", SPEC).alias("v"))
    text = df.select(typed.format_struct(F.col("v"), SPEC)).first()[0]
    assert text == "{a:3,f:2.000,v:[1,2],pos:{x:1,y:2}}"


def test_merged_spec_keeps_the_first_declaration():
    merged = typed.merged_spec([(Field("x", type="int8_t"),), (Field("x", type="float"), POINT)])
    assert [(f.name, f.type) for f in merged] == [("x", "int8_t"), ("pos", None)]


def test_type_tables():
    assert spark_type("uint32_t").simpleString() == "bigint"
    assert [storage_class(t) for t in ("float", "uint8_t", "string", "double")] == [
        "REAL", "INTEGER", "TEXT", "BLOB"
    ]


def test_paths_and_integers(spark):
    df = spark.createDataFrame(
        [("b:in-a:out",), ("b:in",), ("b:in-a",), ("b:i:n-a:o",), ("x-y:z-w:v",)], "p string"
    )
    got = [r[0] for r in df.select(sc.split_path("p")).collect()]
    assert tuple(got[0]) == ("b", "in", "a", "out") and got[1:] == [None] * 4
    df = spark.createDataFrame([("0x1F", "1f"), ("12", "12")], "a string, b string")
    assert rows(df.select(sc.parse_int("a"), sc.parse_int("b", 16))) == [(12, 18), (31, 31)]
    df = spark.createDataFrame([("base_3_17",), ("base",)], "p string")
    assert rows(df.select(sc.parent_id("p"), sc.level_of("p"))) == [("", 0), ("base_3", 2)]


def test_colours(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (99.0,)], "v double")
    assert [r[0] for r in df.select(style.heat_colour(F.col("v"), 0, 10)).collect()] == [
        "#0000ff", "#0000ff", "#ffffff", "#ff0000", "#ff0000"
    ]
    four = style.blend_colour(F.col("v"), (0, 0, 0, 0), (255, 100, 50, 10), 0, 10)
    assert [r[0] for r in df.select(four).collect()][2] == "#7f321905"


def test_styles_fall_back_when_types_are_many(spark):
    types = spark.createDataFrame([(c,) for c in "abcd"], "m string")
    got = rows(style.style_by_type(types, "m", style.COLOURS, style.TOO_MANY_COLOUR))
    assert got == [(c, "black") for c in "abcd"]
    few = rows(style.style_by_type(types.limit(2), "m", style.COLOURS))
    assert [s for _, s in few] == ["blue4", "red4"]
