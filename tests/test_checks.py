"""One seeded violation per rule, and none on a clean graph."""

import pytest
from pyspark.sql import functions as F

from portmesh.functions.typed import Field
from portmesh.operators import checks
from portmesh.tables import Model


@pytest.fixture(scope="module")
def clean(spark):
    df = spark.createDataFrame
    return Model(
        message_types=df([("m",), ("n",)], "id string"),
        device_types=df([("t",), ("u",)], "id string"),
        ports=df(
            [("t", "out", "output", 0, "m"), ("u", "in", "input", 0, "m"), ("u", "odd", "input", 1, "n")],
            "device_type string, name string, direction string, idx int, message_type string",
        ),
        devices=df([("a", "t", '"p":1'), ("b", "u", None)], "id string, type string, props string"),
        edges=df(
            [("a", "b", "out", "in", "b:in-a:out")],
            "source string, target string, source_port string, target_port string, path string",
        ),
        events=df(
            [("s", "a", "send", 1.0, 1, None, False, 1), ("r", "b", "recv", 2.0, 1, "s", None, None)],
            "id string, dev string, type string, time double, seq bigint, send_id string,"
            "cancel boolean, fanout int",
        ),
        edge_states=df(
            [("b:in-a:out", 1, None, 0, 0)],
            "id string, epoch bigint, state string, firings bigint, queued bigint",
        ),
    )


SPECS = {"t": (Field("p", type="uint8_t"),), "u": ()}


def _rules(model):
    return sorted({r["rule"] for r in checks.validate(model, SPECS).collect()})


def test_clean_graph_has_no_violations(clean):
    assert checks.validate(clean, SPECS).count() == 0


EDGE = "source string, target string, source_port string, target_port string, path string"
EVENT = (
    "id string, dev string, type string, time double, seq bigint, send_id string,"
    "cancel boolean, fanout int"
)


@pytest.mark.parametrize(
    "rules, table, row, schema",
    [
        (["V1"], "devices", ("a", "t", None), "id string, type string, props string"),
        (["V1"], "edges", ("a", "b", "out", "in", "b:in-a:out"), EDGE),
        (["V2"], "message_types", ("m",), "id string"),
        (["V2"], "device_types", ("u",), "id string"),
        (["V3"], "devices", ("c", "w", None), "id string, type string, props string"),
        (["V4"], "edges", ("a", "z", "out", "in", "z:in-a:out"), EDGE),
        (["V5"], "edges", ("a", "b", "out", "no", "b:no-a:out"), EDGE),
        (["V6"], "edges", ("a", "b", "out", "odd", "b:odd-a:out"), EDGE),
        (["V7"], "devices", ("c", "t", '"p":300'), "id string, type string, props string"),
        (["V7"], "devices", ("c", "t", '"q":1'), "id string, type string, props string"),
        (["V8"], "devices", ("c d", "t", None), "id string, type string, props string"),
        (["V9"], "events", ("i", "a", "init", 0.5, 2, None, None, None), EVENT),
        (["V10"], "events", ("q", "b", "recv", 3.0, 2, "zz", None, None), EVENT),
        (["V10", "V12"], "events", ("q", "a", "send", 3.0, 2, None, True, 3), EVENT),
        (["V12"], "events", ("q", "a", "send", 3.0, 2, None, False, 3), EVENT),
        (
            ["V11"], "edge_states", ("x", 1, None, 4, 0),
            "id string, epoch bigint, state string, firings bigint, queued bigint",
        ),
    ],
)
def test_seeded_violation(spark, clean, rules, table, row, schema):
    extra = spark.createDataFrame([row], schema)
    model = clean.with_tables(**{table: getattr(clean, table).unionByName(extra)})
    assert _rules(model) == rules


def test_unregistered_message_type(spark, clean):
    ports = clean.ports.withColumn(
        "message_type", F.when(F.col("name") == "odd", "gone").otherwise(F.col("message_type"))
    )
    assert _rules(clean.with_tables(ports=ports)) == ["V3"]
