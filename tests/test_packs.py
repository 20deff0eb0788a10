"""XML elements are parsed in packs, and each as it would be alone."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.sinks import xml
from portmesh.sources import xml_log, xml_snapshots
from portmesh.sources.xml_scan import PACK_BYTES, PACK_ROWS, parsed, scan_elements

ODD = [
    '<SendEvent eventId="a&amp;b" time="1" port="o"><M> 1 &lt; 2 </M><L>x</L><L/><L>y</L></SendEvent>',
    "<SendEvent eventId='s'></SendEvent>",
    '<SendEvent eventId="t"/>',
    "<SendEvent/>",
    '<SendEvent eventId="u">text<S><![CDATA["v":<1>]]></S>more<Other><S>deep</S></Other></SendEvent>',
    '<RecvEvent eventId="r" sendEventId="s"><!-- </RecvEvent> --><S/></RecvEvent>',
    '<InitEvent eventId="i" time="0"><S>"v":1</S><S>"v":2</S></InitEvent>',
]
BROKEN = ['<SendEvent eventId="w"><S>x</M></SendEvent>', '<SendEvent eventId="v"><S>1</S>', '<RecvEvent eventId="q" a=1/>']


def _alone(spark, texts, schema):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    options = {"valueTag": "_text", "ignoreNamespace": "true"}
    one = F.from_xml("text", schema, options).alias("_e")
    return rows(df.select(one, F.regexp_extract("text", r"^<(\w+)", 1).alias("tag")).select("_e.*", "tag"))


@pytest.mark.parametrize("broken", [[], BROKEN, BROKEN[:1], BROKEN[1:2], BROKEN[2:]])
def test_packs_hold_what_single_elements_hold(spark, broken):
    kinds = ("init", "send", "recv")
    schema = T.StructType(list({f.name: f for k in kinds for f in xml_log.event_schema(k)}.values()))
    texts = [*ODD, *broken, *ODD[:2]]
    packs = spark.createDataFrame([(texts, None), (broken, None), (ODD[:1], ["x"])], "texts array<string>, around array<string>")
    got = parsed(packs, "InitEvent SendEvent RecvEvent", schema)
    assert rows(got.drop("around")) == _alone(spark, [*texts, *broken, ODD[0]], schema)
    assert got.where("around[0] = 'x'").count() == 1


def test_elements_come_in_packs(spark, tmp_path):
    n = 5000
    body = "".join(f'<RecvEvent eventId="r{i}" time="{i}"/>' for i in range(n))
    (tmp_path / "l.xml").write_text(f"<GraphLog>{body}</GraphLog>")
    found = scan_elements(spark, str(tmp_path), "RecvEvent")
    sizes = [r[0] for r in found.select(F.size("texts")).collect()]
    assert sum(sizes) == n and max(sizes) <= PACK_ROWS and len(sizes) < n / 20
    assert xml_log.read_events(spark, str(tmp_path)).select("id").distinct().count() == n


def test_packs_are_cut_at_snapshots_and_large_elements(spark, tmp_path):
    big = "x" * PACK_BYTES
    (tmp_path / "s.xml").write_text(
        "<Graph>" + "".join(
            f'<GraphSnapshot graphInstId="g" sequenceNumber="{e}" orchestratorTime="{e}"><DevS id="a"/><DevS id="b"><S>{big}</S></DevS>'
            '<DevS id="c"/></GraphSnapshot>' for e in range(3)
        ) + "</Graph>"
    )
    found = scan_elements(spark, str(tmp_path), "DevS", "GraphSnapshot", "sequenceNumber")
    assert all(len(r.texts) == 1 for r in found.collect() if max(map(len, r.texts)) > PACK_BYTES)
    got = xml_snapshots.read_device_states(spark, str(tmp_path)).select("id", "epoch", F.length("state"))
    assert rows(got) == rows(spark.createDataFrame(
        [(d, e, PACK_BYTES if d == "b" else None) for d in "abc" for e in range(3)], "id string, epoch bigint, n int"
    ))


def test_compressed_events_in_small_files(spark, tmp_path):
    events = spark.range(2500).selectExpr(
        "if(id = 7, 'a&<b', concat('e', id)) as id", "concat('d', id % 9) as dev", "if(id % 3 = 0, 'send', 'recv') as type",
        "id / 2 as time", "0.0 as elapsed", "id % 4 as rts", "id as seq", "'p' as port", "if(id % 3 = 0, null, concat('e', id - 1)) as send_id",
        "if(id % 3 = 0, id % 2 = 0, null) as cancel", "if(id % 3 = 0, 3, null) as fanout", "if(id % 3 = 0, '\"w\":1', null) as m",
        "if(id % 5 = 0, null, concat('\"v\":', id)) as s", "array('seen', concat('<', id, '>')) as l",
    )
    xml.write_events_xml(events, f"{tmp_path}/plain")
    xml.write_events_xml(events, f"{tmp_path}/packed", compressed=True, per_file=100)
    got = xml_log.read_events(spark, f"{tmp_path}/packed")
    assert rows(got) == rows(xml_log.read_events(spark, f"{tmp_path}/plain")) and got.count() == 2500
    files = [*(tmp_path / "packed").rglob("part-*")]
    assert all(f.name.endswith(".xml.gz") for f in files) and len(files) >= 25
    size = lambda folder: sum(f.stat().st_size for f in (tmp_path / folder).rglob("part-*"))
    assert size("packed") < size("plain") / 2
