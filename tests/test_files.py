"""XML, METIS, DOT and table files: golden documents and round trips."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.functions.typed import specs_of, widen
from portmesh.operators.rollups import undirected_weights
from portmesh.plans import build, views
from portmesh.sinks import tables, text, xml
from portmesh.sources import lines, metis, xml_graph, xml_log
from portmesh.sources.generators import gen_heat_plate
from portmesh.tables import Model

GRAPH = """<?xml version="1.0"?>
<Graphs xmlns="urn:example:graph">
  <GraphType id="g"><Properties><Scalar name="limit" type="uint32_t" default="7"/></Properties>
    <MessageTypes><MessageType id="m"><Message><Scalar name="w" type="float"/>
      <Tuple name="at"><Scalar name="x" type="int8_t"/><Array name="h" length="3" type="int16_t"/>
      </Tuple></Message><MetaData>"k":[1,2]</MetaData></MessageType></MessageTypes>
    <DeviceTypes><DeviceType id="t">
      <Properties><Scalar name="p" type="float"/><Array name="arr" length="2" type="int8_t"/></Properties>
      <State><Scalar name="s" type="int32_t"/></State>
      <InputPort name="in" messageTypeId="m"><Properties><Scalar name="c" type="float"/></Properties>
        <OnReceive><![CDATA[ if(a<b && c>d){} ]]></OnReceive></InputPort>
      <OutputPort name="out" messageTypeId="m"/></DeviceType></DeviceTypes></GraphType>
  <GraphInstance id="i1" graphTypeId="g"><Properties>"limit":3</Properties>
    <DeviceInstances><DevI id="a" type="t"><P>"p":1.5,"arr":[1,2]</P><M>"z":1</M></DevI>
      <DevI id="b" type="t"/></DeviceInstances>
    <EdgeInstances><EdgeI path="b:in-a:out"><P>"c":0.5</P></EdgeI>
      <EdgeI dstDeviceId="a" dstPortName="in" srcDeviceId="b" srcPortName="out"/>
      <EdgeI path="broken"/></EdgeInstances></GraphInstance>
</Graphs>"""

OLD = """<Graphs><GraphType id="old"><EdgeTypes><EdgeType id="e"/></EdgeTypes><DeviceTypes>
<DeviceType id="d"><Properties><Scalar name="q" type="float" value="2"/></Properties>
<InputPort name="in" edgeTypeId="e"/></DeviceType></DeviceTypes></GraphType>
<GraphInstance id="o" graphTypeId="old"><DeviceInstances><DevI id="x" type="d">
<Properties>"q":4</Properties></DevI></DeviceInstances></GraphInstance></Graphs>"""


@pytest.fixture(scope="module")
def graph(tmp_path_factory):
    path = tmp_path_factory.mktemp("graph")
    (path / "g.xml").write_text(GRAPH)
    return str(path)


def test_catalogue(spark, graph):
    c = xml_graph.read_graph_types(spark, graph)
    fields = rows(c.type_fields.select("owner", "port", "section", "path", "kind", "type", "length", "default"))
    assert fields == sorted(
        [
            ("g", None, "properties", "limit", "scalar", "uint32_t", None, "7"),
            ("m", None, "message", "w", "scalar", "float", None, None),
            ("m", None, "message", "at", "tuple", None, None, None),
            ("m", None, "message", "at.x", "scalar", "int8_t", None, None),
            ("m", None, "message", "at.h", "array", "int16_t", 3, None),
            ("t", None, "properties", "p", "scalar", "float", None, None),
            ("t", None, "properties", "arr", "array", "int8_t", 2, None),
            ("t", None, "state", "s", "scalar", "int32_t", None, None),
            ("t", "in", "properties", "c", "scalar", "float", None, None),
        ],
        key=lambda r: tuple(map(str, r)),
    )
    assert rows(c.ports.select("device_type", "name", "direction", "message_type")) == [
        ("t", "in", "input", "m"), ("t", "out", "output", "m")
    ]
    nested = specs_of(c.type_fields, "message")[("m", None)]
    assert [f.name for f in nested] == ["w", "at"]
    assert [m.name for m in nested[1].members] == ["x", "h"]
    meta = c.message_types.select(F.expr("variant_get(metadata, '$.k[1]', 'int')")).first()[0]
    assert meta == 2


def test_instances(spark, graph):
    assert rows(xml_graph.read_devices(spark, graph, graph_id=True)) == [
        ("a", "t", '"p":1.5,"arr":[1,2]', '"z":1', "i1"), ("b", "t", None, None, "i1")
    ]
    edges = xml_graph.read_edges(spark, graph)
    assert rows(edges.select("id", "source", "target_port", "props")) == [
        ("a:in-b:out", "b", "in", None), ("b:in-a:out", "a", "in", '"c":0.5'),
        ("broken", None, None, None),
    ]
    assert [r["id"] for r in xml_graph.malformed_edges(edges).collect()] == ["broken"]
    assert rows(xml_graph.read_graphs(spark, graph).select("id", "graph_type", "props")) == [
        ("i1", "g", '"limit":3')
    ]
    assert rows(xml_graph.read_graphs(spark, graph, properties=False)) == [("i1", "g")]


def test_older_spelling(spark, tmp_path):
    (tmp_path / "o.xml").write_text(OLD)
    c = xml_graph.read_graph_types(spark, str(tmp_path))
    assert rows(c.ports.select("name", "message_type")) == [("in", "e")]
    assert rows(c.type_fields.select("name", "default")) == [("q", "2")]
    devices = xml_graph.read_devices(spark, str(tmp_path))
    spec = specs_of(c.type_fields, "properties")[("d", None)]
    assert rows(widen(devices.select("id", "props"), spec)) == [("x", 4.0)]


def test_type_declarations_round_trip(spark, graph, tmp_path):
    c = xml_graph.read_graph_types(spark, graph)
    xml.write_graph_types_xml(c, str(tmp_path / "t"), namespace="urn:example:graph")
    back = xml_graph.read_graph_types(spark, str(tmp_path / "t"))
    assert rows(back.type_fields.drop("idx")) == rows(c.type_fields.drop("idx"))
    assert rows(back.ports) == rows(c.ports)


def test_type_references(spark, tmp_path, graph):
    (tmp_path / "r.xml").write_text(
        '<Graphs><GraphTypeReference id="g" src="g.xml"/><GraphTypeReference id="h" src="g.xml"/></Graphs>'
    )
    refs = xml_graph.read_type_references(spark, str(tmp_path))
    found = xml_graph.resolve_type_refs(refs, xml_graph.read_graph_types(spark, graph).graph_types)
    assert rows(found) == [("g", "g.xml", True), ("h", "g.xml", False)]


def test_line_numbers_across_splits(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 17) for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(want) + "\n")
    (tmp_path / "small.txt").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = lines.read_numbered_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 1
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.pop(("small.txt", 0)) == "only"
    assert got == {("big.txt", i): v for i, v in enumerate(want)}


def test_metis_document(spark, tmp_path):
    nodes = spark.createDataFrame([("base", n) for n in "abcd"], "parent string, id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "d")], "source string, target string")
    text.write_metis(nodes, undirected_weights(edges), str(tmp_path / "m"))
    files = sorted((tmp_path / "m" / "parent=base").glob("part-*"))
    whole = "".join(f.read_text() for f in files)
    assert [line.split() for line in whole.strip(" ").split("\n")] == [
        ["4", "2", "001"], ["2", "2"], ["1", "2", "4", "1"], [], ["2", "1"], []
    ]
    (tmp_path / "one.graph").write_text("3 2 001\n2 5 \n1 5 3 1 \n2 1 \n")
    back = metis.read_metis_graph(spark, str(tmp_path / "one.graph"))
    assert rows(back.drop("file")) == [(1, 2, 5), (2, 1, 5), (2, 3, 1), (3, 2, 1)]


def test_metis_parts(spark, tmp_path):
    (tmp_path / "x_base_1.part.2").write_text("0\n1\n1\n")
    got = metis.read_metis_parts(spark, str(tmp_path))
    assert rows(got.drop("file")) == [("base_1", 1, 0), ("base_1", 2, 1), ("base_1", 3, 1)]
    nodes = spark.createDataFrame([("base_1", 2, "n")], "parent string, node bigint, id string")
    assert rows(metis.attach_parts(nodes, got)) == [("n", "base_1_1")]


def test_dot_documents(spark, tmp_path):
    devices = spark.createDataFrame(
        [("a", "t", 0, "#ff0000"), ("b", "u", 0, None), ("a", "t", 1, None), ("b", "u", 1, None)],
        "id string, type string, seq int, fillcolor string",
    )
    edges = spark.createDataFrame(
        [("b:in-a:out", "a", "b", "out", "in", "m", s) for s in (0, 1)],
        "id string, source string, target string, source_port string, target_port string,"
        "message_type string, seq int",
    )
    text.write_dot(devices, edges, str(tmp_path / "d"), graph_id="g", device_attributes=("fillcolor",))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "d" / "seq=0").glob("part-*")))
    assert whole.splitlines() == [
        'digraph "g"{',
        '  sep="+10,10";',
        "  overlap=false;",
        "  spline=true;",
        '  "a" [shape=oval,fillcolor="#ff0000",style="filled"];',
        '  "b" [shape=box,];',
        '  "a" -> "b" [color="blue4",headlabel="in",taillabel="out",label="m"];',
        "}",
    ]


def test_event_dot_document(spark, tmp_path):
    events = spark.createDataFrame(
        [("e0", "d", "init", 0, None, None, '"v":1,"k":0', None),
         ("e1", "d", "send", 1, "out", None, '"v":2,"k":0', '"q":5'),
         ("e2", "f", "recv", 0, "in", "e1", None, None)],
        "id string, dev string, type string, seq bigint, port string, send_id string, s string, m string",
    )
    text.write_event_dot(events, str(tmp_path / "d"))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "d").glob("part-*"))).splitlines()
    head = ['digraph "graph"{', "  overlap=false;", "  newrank=true;"]
    assert whole[:5] == [*head, '  "e1" -> "e2";', "  subgraph cluster_d {"]
    assert '<TD>k</TD><TD >0</TD>' in whole[6] and '<TD>v</TD><TD color="red">2</TD>' in whole[6]
    assert "Send : out" in whole[6] and "<TD>q</TD><TD>5</TD>" in whole[6]
    assert whole[7:10] == ['    "e0" -> "e1" [ style="dotted" ] ;', "  }", "  subgraph cluster_f {"]
    assert whole[-1] == "}"


def test_table_modes(spark, tmp_path):
    one = Model(meta=spark.createDataFrame([("level", 1)], "name string, max bigint"))
    two = Model(meta=spark.createDataFrame([("level", 2)], "name string, max bigint"))
    path = str(tmp_path / "m")
    tables.save_model(one, path)
    with pytest.raises(Exception, match="exists"):
        tables.save_model(two, path)
    tables.save_model(two, path, "ignore")
    assert rows(tables.load_model(spark, path, ["meta"]).meta) == [("level", 1)]
    tables.save_model(two, path, "overwrite")
    assert rows(tables.load_model(spark, path, ["meta"]).meta) == [("level", 2)]
    with pytest.raises(ValueError):
        tables.save_table(two.meta, path, "meta", "replace")


def test_build_from_xml(spark, tmp_path):
    import bench

    bench.plate_files(spark, 8, str(tmp_path))
    built = build.build_from_xml(
        spark, f"{tmp_path}/graph", f"{tmp_path}/log", f"{tmp_path}/snapshots", f"{tmp_path}/model",
        nodes_per_part=10, max_epoch=6, granularity=0, rounds=1,
    )
    devices, edges = gen_heat_plate(spark, 8)
    assert built.devices.count() == devices.count() == 60
    assert built.edges.count() == edges.count()
    assert built.events.count() == 6 * (60 + edges.count())
    # Epoch 0 with sequence 0 is the start, epochs 1 to 6 follow.
    assert built.device_states.groupBy("init").count().orderBy("init").collect()[0]["count"] == 360
    assert rows(built.meta) == [("level", 2), ("time", 6)]
    assert {r["state"] for r in built.value_ranges.collect()} == {
        "v", "t", "messages_sent", "messages_received"
    }
    nodes, arcs = views.drill_down(built, "base", init=0, epoch=3)
    assert nodes.count() == 6 and nodes.agg(F.sum("messages_sent")).first()[0] == 360
    back = xml_log.read_events(spark, f"{tmp_path}/log", max_time=6)
    assert rows(back.select("id", "rts")) == rows(built.events.select("id", "rts"))
