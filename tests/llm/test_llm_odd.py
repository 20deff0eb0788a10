"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from llm_cases import odd_docs
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from portmesh.llm import chunk_dedup, html_blocks, jaccard_join, licenses, line_frequency, line_spread, mixing, templates, token_shards, word_pieces

ITEMS = "item_id long, text string, h string, width string"


def items(spark, rows=((1, "Second line of a document that goes on for a while, as they do", "x", "y"), (None, None, None, None), (2, "", "", ""), (3, "a b", "", ""))):
    return spark.createDataFrame(list(rows), ITEMS)


def per_row(spark):
    path = word_pieces.default_vocabulary()
    return {
        "word_pieces": lambda d: word_pieces.token_counts(d, path),
        "profile": lambda d: line_frequency.verdicts(line_frequency.profile(d)),
        "line_spread": lambda d: line_spread.removals(line_spread.line_table(d)),
        "line_dedup": line_spread.line_dedup,
        "licenses": licenses.license_scan,
        "mixed": mixing.mixed,
        "mix_sources": mixing.mix_sources,
        "near_duplicates": jaccard_join.near_duplicates,
        "token_output": lambda d: token_shards.token_output(d, path),
        "without_passages": lambda d: chunk_dedup.without_passages(d, chunk_dedup.repeated_passages(d)),
    }


def fewer(spark):
    return {
        "quality_rules": line_frequency.quality_rules,
        "passages": chunk_dedup.repeated_passages,
        "contaminated": lambda d: templates.contaminated(d, items(spark)),
        "decontaminate": lambda d: templates.decontaminate(d, items(spark)),
        "one_of_each": jaccard_join.one_of_each,
    }


NAMES = ["word_pieces", "profile", "line_spread", "line_dedup", "licenses", "mixed", "mix_sources", "near_duplicates", "token_output", "without_passages"]
FEWER = ["quality_rules", "passages", "contaminated", "decontaminate", "one_of_each"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, name):
    docs = odd_docs(spark)
    out = per_row(spark)[name](docs)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    assert ids(out) == ids(docs)
    if name in ("line_dedup", "mix_sources", "without_passages"):
        assert out.dtypes == docs.dtypes


@pytest.mark.parametrize("name", NAMES + FEWER)
def test_empty_table(spark, name):
    docs = odd_docs(spark, rows=[])
    out = (per_row(spark) | fewer(spark))[name](docs)
    assert out.count() == 0


@pytest.mark.parametrize("name", NAMES + FEWER)
def test_all_null(spark, name):
    docs = odd_docs(spark, rows=[(None,) * 5] * 3)
    out = (per_row(spark) | fewer(spark))[name](docs)
    want = {"quality_rules": 0, "passages": 0, "contaminated": 0}.get(name, 3)
    assert out.count() == want


def texts(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_quality_rules(spark):
    docs = odd_docs(spark)
    kept = line_frequency.quality_rules(docs)
    assert kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(["1", "1", "None", "None", "7", "7", "8", "-10"])


def test_boilerplate_goes_and_copied_documents_stay(spark):
    banner = "Accept all the cookies of this site to go on"
    body = [f"document {chr(97 + i)}{'x' * i} has a line of its own with more than ten words in it\nand a {'y' * i} second" for i in range(30)]
    rows = [(i, f"{banner}\n{b}" if i % 2 else b, "en", "host", 0) for i, b in enumerate(body)]
    copied = "this text was copied many times over on one host by its owner\nand it has two lines"
    rows += [(100 + i, copied, "en", "host", 0) for i in range(40)]
    rows += [(200, banner, "en", "host", 0)]
    kept = {r.doc_id: r for r in line_frequency.quality_rules(odd_docs(spark, rows, clash=False)).collect()}
    assert set(kept) == {*range(30), *range(100, 140)}
    assert all(kept[i].text == body[i] and (i % 2 == 0 or kept[i].n_chars == len(body[i])) for i in range(30))


@pytest.mark.parametrize(("n_docs", "n_lines"), [(10, 6), (1000, 60)])
def test_a_template_on_all_of_a_host_goes(spark, n_docs, n_lines):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    template = "\n".join(f"line {letters(i)} of the template of this host" for i in range(n_lines))
    body = [f"document {letters(i)} has a line of its own with more than ten words in it, long enough to stay" for i in range(n_docs)]
    rows = [(i, f"{template}\n{b}", "en", "host", 0) for i, b in enumerate(body)]
    lines = line_frequency.frequent_lines(line_frequency.profile(odd_docs(spark, rows, clash=False)))
    assert [r.n_docs for r in lines.collect()] == [n_docs] * n_lines


def test_lines_on_many_sites_stay_once(spark):
    line = "Subscribe to our letter today"
    rows = [(i, f"own words of {i} here\n{line}\n{line}", "en", f"s{i}", 0) for i in range(20)]
    rows += [(50 + i, f"on few sites only this\nother {i} words", "en", f"s{i % 7}", 0) for i in range(20)]
    docs = odd_docs(spark, rows)
    got = {r.doc_id: r.text for r in line_spread.line_dedup(docs).collect()}
    assert got[0] == f"own words of 0 here\n{line}"
    # digits are alike to the rules: 'own words of 0 here' is one line for all
    assert all(got[i] == "" for i in range(1, 20))
    assert all(got[50 + i].startswith("on few sites") for i in range(20))


def test_rows_given_twice_keep_a_first_line(spark):
    line = "Subscribe to our letter today"
    rows = [(i // 2, f"own {'x' * (i // 2)} words\n{line}", "en", f"s{i // 2}", 0) for i in range(20)]
    got = sorted((r.doc_id, r.text) for r in line_spread.line_dedup(odd_docs(spark, rows)).collect())
    assert got == [(i // 2, f"own {'x' * (i // 2)} words" + (f"\n{line}" if i < 2 else "")) for i in range(20)]


def test_near_the_limit_sites_are_counted(spark):
    n = 400
    rows = [(10_000 * k + i, f"line number {'abcdef'[k]} of all", "en", f"site{i}", 0) for k, m in enumerate((n - 1, n, n + 1, n - 80)) for i in range(m)]
    wide = line_spread.wide_lines(line_spread.line_table(odd_docs(spark, rows, clash=False)), n)
    assert wide.count() == 2


def test_one_of_each(spark):
    docs = odd_docs(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 7 is a copy of 1 (given twice); the text without an id was given twice; texts without words all stay
    assert ids == sorted(["1", "1", "2", "3", "4", "None", "5", "6", "8", "9", "-10"])


def test_decontaminate(spark):
    docs = odd_docs(spark)
    out = templates.decontaminate(docs, items(spark))
    assert out.dtypes == docs.dtypes
    gone = docs.count() - out.count()
    assert gone == 3  # one of the two rows with id 1, both with id 7
    assert templates.contaminated(docs, items(spark, [])).count() == 0


def test_mix_order_is_stored(spark):
    docs = odd_docs(spark, [(i, f"text {i}", "en", "ab"[i % 3 == 0], 0) for i in range(300)], clash=False)
    order = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(docs).collect()}
    got = [order[r.doc_id] for r in mixing.mix_sources(docs).collect()]
    assert got == sorted(got)


def test_pages(spark):
    kinds = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>one", "x", "y"), (1, "u", "<p>one", "x", "y"), (None, None, None, None, None), (2, "", "", "", ""), (3, "l", "<article>" + "<p>word " * 40_000, "", "")]
    got = html_blocks.extract(spark.createDataFrame(rows, kinds))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r.page_id, r.n_chars) for r in got.collect()}
    assert got.count() == 5 and found == {(1, 3), (None, 0), (2, 0), (3, 40_000 * 5 - 1)}
    assert html_blocks.extract(spark.createDataFrame([], kinds)).count() == 0


@pytest.mark.parametrize("rows", [None, []])
def test_pipeline_stages(spark, rows):
    docs = odd_docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kinds = docs.dtypes
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.dtypes == kinds, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert [c for c, _ in last.dtypes] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert last.count() == docs.count()
    assert isinstance(docs.schema["doc_id"].dataType, T.LongType)
