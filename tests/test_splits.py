"""XML files are read from splits of any size, with the rows of a plain parser."""

import xml.etree.ElementTree as ET

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.sources import xml_graph, xml_log, xml_scan, xml_snapshots


@pytest.fixture
def splits(spark, request):
    """Splits of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def graph_text(n, tag):
    """``tag`` stands in comments and CDATA sections."""
    devices = []
    for i in range(n):
        if i % 5 == 0:
            devices.append(f'<DevI id="d{i}" type="t&lt;{i % 3}" />')
        elif i % 5 == 1:
            devices.append(f"<DevI type='a>b' id='d{i}'><P>\"x\":{i},\"s\":\"p &amp; q > {'y' * (i % 90)}\"</P></DevI>")
        elif i % 5 == 2:
            devices.append(f'<DevI\n id="d{i}"\n type="t"><P><![CDATA["c":"<{tag} id=\'no\'/> </{tag}>"]]></P><M>"m":1</M>\n</DevI >')
        elif i % 5 == 3:
            devices.append(f'<!-- <{tag} id="not{i}" type="t"><P>1</P></{tag}> --><DevI id="d{i}" type="t"><Properties>"z":{i}</Properties></DevI>')
        else:
            devices.append(f'<DevI id="d{i}" type="t"></DevI>')
    edges = [f'<EdgeI path="d{i}:in-d{i + 1}:out"' + ("/>" if i % 2 else "><P>\"w\":1</P></EdgeI>") for i in range(n)]
    types = (
        '<GraphType id="g"><Properties>' + "".join(f'<Tuple name="t{k}">' for k in range(6))
        + '<Scalar name="deep" type="float"/>' + "</Tuple>" * 6 + '<Tuple name="none"/></Properties><SharedCode><![CDATA[ if (a < b) '
        + "x" * 3000 + f" <{tag}> ]]></SharedCode></GraphType>"
    )
    parts = [
        f'<GraphInstance id="i{k}" graphTypeId="g"><Properties>"limit":{k}</Properties><MetaData>"k":{k}</MetaData>'
        f"<DeviceInstances>{''.join(devices[k::2])}</DeviceInstances>\n<EdgeInstances>{''.join(edges[k::2])}</EdgeInstances></GraphInstance>"
        for k in range(2)
    ]
    return f'<?xml version="1.0"?>\n<Graphs xmlns="urn:example">{types}{"".join(parts)}</Graphs>\n'


def plain_graph(text):
    root = ET.fromstring(text)
    ns = "{urn:example}"
    devices, edges, graphs = [], [], []
    for g in root.iter(f"{ns}GraphInstance"):
        graphs.append((g.get("id"), "g", g.find(f"{ns}Properties").text, g.find(f"{ns}MetaData").text))
        for d in g.iter(f"{ns}DevI"):
            found = {x.tag.removeprefix(ns): x.text for x in d}
            devices.append((d.get("id"), d.get("type"), found.get("P", found.get("Properties")), found.get("M"), g.get("id")))
        edges += [(e.get("path"), e.findtext(f"{ns}P"), g.get("id")) for e in g.iter(f"{ns}EdgeI")]
    return devices, edges, graphs


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("splits", [900, 9000, 100_000_000], indirect=True)
def test_graph(spark, tmp_path, splits):
    n = 60 if splits < 1000 else 400
    text = graph_text(n, "Dev" if splits < 1e6 else "DevI")
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.xml").write_text('<Graphs xmlns="urn:example"><GraphInstance id="e" graphTypeId="g"/></Graphs>')
    devices, edges, graphs = plain_graph(text)
    got = xml_graph.read_devices(spark, str(tmp_path), graph_id=True)
    assert rows(got) == sorted(devices, key=key)
    if splits < 1e6:
        tasks = spark.read.option("lineSep", "<").text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > len(text) / splits / 2
    got = xml_graph.read_edges(spark, str(tmp_path), graph_id=True).select("path", "props", "graph_id")
    assert rows(got) == sorted(edges, key=key)
    assert rows(xml_graph.read_graphs(spark, str(tmp_path))) == sorted([*graphs, ("e", "g", None, None)], key=key)
    assert rows(xml_graph.read_graphs(spark, str(tmp_path), properties=False)) == [("e", "g"), ("i0", "g"), ("i1", "g")]
    fields = xml_graph.read_graph_types(spark, str(tmp_path)).type_fields
    paths = [".".join(f"t{k}" for k in range(i + 1)) for i in range(6)]
    assert rows(fields.select("path")) == sorted((p,) for p in [*paths, f"{paths[-1]}.deep", "none"])


@pytest.mark.parametrize("splits", [30_000], indirect=True)
def test_one_large_snapshot(spark, tmp_path, splits):
    """A snapshot is read by many tasks, and each row knows its snapshot."""
    n = 3000
    with open(tmp_path / "s.xml", "w") as f:
        f.write('<Graph xmlns="urn:example">')
        for e in (0, 1, 7):
            f.write(f'<GraphSnapshot graphTypeId="t" orchestratorTime="{e}.5" sequenceNumber="{e}" graphInstId="g&amp;{e}">\n')
            f.writelines(f'<DevS id="d{i}" rts="{i % 32:x}"><S>"v":{i + e}</S></DevS>\n' if i % 7 else f'<DevS id="d{i}"/>' for i in range(n))
            f.writelines(f'<EdgeS id="e{i}" firings="1a"><S>"n":1</S><Q><M>"a":{i}</M><M>2</M></Q></EdgeS>\n' for i in range(n // 3))
            f.write("</GraphSnapshot>\n")
        f.write("</Graph>")
    got = xml_snapshots.read_device_states(spark, str(tmp_path))
    want = [
        (f"d{i}", f"g&{e}", e, e, i % 32 if i % 7 else 0, f'"v":{i + e}' if i % 7 else None) for e in (0, 1, 7) for i in range(n)
    ]
    assert rows(got.select("id", "graph_id", "sequence", "epoch", "rts", "state")) == sorted(want, key=key)
    assert got.groupBy(F.spark_partition_id()).count().count() > 1
    late = xml_snapshots.read_device_states(spark, str(tmp_path), max_epoch=2)
    assert rows(late.select("epoch").distinct()) == [(0,), (1,)]
    edges = xml_snapshots.read_edge_states(spark, str(tmp_path)).select("id", "epoch", "firings", "messages", "queued")
    want = [(f"e{i}", e, 26, [f'"a":{i}', "2"], 2) for e in (0, 1, 7) for i in range(n // 3)]
    assert rows(edges) == sorted(want, key=key)


@pytest.mark.parametrize("splits", [9000], indirect=True)
def test_log_in_one_scan(spark, tmp_path, splits):
    body = "".join(
        f'<InitEvent eventId="i{i}" time="{i}" elapsed="0" dev="d" rts="0x1" seq="0"><S>"v":{i}</S></InitEvent>'
        f'<SendEvent eventId="s{i}" time="{i}" elapsed="0" dev="d" rts="0x0" seq="1" port="o" cancel="0" fanout="2"><M>1</M><L>a</L><L>b</L></SendEvent>'
        f'<RecvEvent eventId="r{i}" time="{i}" elapsed="0" dev="e" rts="0x0" seq="2" port="i" sendEventId="s{i}"/>'
        for i in range(300)
    )
    (tmp_path / "l.xml").write_text(f"<GraphLog>{body}</GraphLog>")
    got = xml_log.read_events(spark, str(tmp_path), max_time=250)
    found = rows(got.select("id", "type", "time", "port", "send_id", "cancel", "fanout", "m", "s", "l"))
    want = []
    for i in range(251):
        want += [
            (f"i{i}", "init", float(i), None, None, None, None, None, f'"v":{i}', None),
            (f"s{i}", "send", float(i), "o", None, False, 2, "1", None, ["a", "b"]),
            (f"r{i}", "recv", float(i), "i", f"s{i}", None, None, None, None, None),
        ]
    assert found == sorted(want, key=key)


def test_attributes():
    tags = ['GraphSnapshot a="1" bb=\'x "y"\' c = "&lt;&amp;lt;">', "GraphSnapshot>", 'GraphSnapshot xa="no" a="" />']
    found = [xml_scan.attributes(t, ("a", "bb", "c")) for t in tags]
    assert found == [["1", 'x "y"', "<&lt;"], [None, None, None], ["", None, None]]


def test_no_files_with_the_element(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<Graphs></Graphs>")
    (tmp_path / "y.xml").write_text("")
    for read in (xml_graph.read_devices, xml_graph.read_edges, xml_graph.read_graphs, xml_log.read_events, xml_snapshots.read_device_states):
        assert read(spark, str(tmp_path)).count() == 0
    assert xml_graph.read_graph_types(spark, str(tmp_path)).type_fields.count() == 0
