"""The registered queries against their SQL twins, and the pipeline stage by stage against plain versions."""

import zlib

import compare
import duckdb
import numpy as np
import pytest
from llm_cases import near_groups, template_hits

import __spark_entry__
import corpus_pipeline
from portmesh.llm import line_frequency, mixing, registry, templates, token_shards
from portmesh.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    problem = compare.check(spark, compare.connect(FOLDER), name, registry.QUERIES[name], registry.SQL[name], FOLDER)
    assert problem is None, problem


def test_lines_count_documents_by_their_line_sets(spark):
    """Documents of a template and one line of their own: each is a document for the template's lines, though the least
    and the greatest of a document's other hashes are mostly the template's."""
    template = [f"template line number {'abcdefghij'[k]} of this site with some words" for k in range(8)]
    rows = [(i, "\n".join([*template, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(14))]), "h", "en") for i in range(60)]
    rows += [(100 + i, rows[0][1], "h", "en") for i in range(20)] + [(200, None, "h", "en"), (201, "", "h", "en"), (202, "\n\n", "h", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = line_frequency.verdicts(line_frequency.profile(docs)).select("doc_id", "kept", "n_left").collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(f"select doc_id, kept, n_left from ({line_frequency.OP2_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.n_left for r in got if r.doc_id < 100} == {14}


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    tables = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, FOLDER), f"test{i}")
        tables.append(docs.collect())
    quality, near, clean, mixed, tokens = tables

    # 1: the documents that the SQL keeps
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({line_frequency.OP2_SQL}) where kept").fetchall()}
    assert {r.doc_id for r in quality} == kept and len(quality) == len(kept)
    assert all(r.n_chars == len(r.text) for r in quality)

    # 2: one of each group, the least
    rows = sorted((r.doc_id, r.text) for r in quality)
    groups = near_groups(rows)[1]
    assert sorted(r.doc_id for r in near) == sorted({rows[g][0] for g in groups})

    # 3: without benchmark items
    items = con.execute(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    hits = template_hits([(r.doc_id, r.text) for r in near], items, set(templates.UNITS))
    assert sorted(r.doc_id for r in clean) == sorted({r.doc_id for r in near} - {d for d, _, _ in hits})
    assert hits

    # 4: the same rows in the order of the mix
    assert sorted(mixed) == sorted(clean)
    order = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(spark.createDataFrame(clean)).collect()}
    assert [order[r.doc_id] for r in mixed] == sorted(order.values())

    # 5: their ids in that order
    whole = token_shards.encoder(token_shards.default_tokenizer()).whole
    start, want = 0, []
    for r in mixed:
        ids = np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens), key=lambda r: r[1]) == want
