"""Cross-site line de-duplication by distinct-site spread, in DataFrame functions only.

Lines are normalised and hashed. Each line hash has a HyperLogLog sketch of the sites (``source``) that
hold it; partial sketches of the scan's tasks merge in the aggregation. Lines whose estimate is clearly
above the limit are boilerplate, clearly below are not; those near it get exact distinct counts. A
boilerplate line stays in its first place (least document, then line number) and is removed elsewhere.

One pass over the texts stores the line hashes; the rest works on those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import stored, table, words_of
from portmesh.llm.line_frequency import line_hash

#: Distinct sites from which a line is boilerplate, and the fewest words of such a line.
LEAST_SITES, LEAST_WORDS = 8, 3
#: log2 of the sketch's registers, and how far from the limit an estimate decides: 4 standard errors.
LG_K = 11
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)


def line_table(docs: DataFrame) -> DataFrame:
    """A stored row per document: ``row_id``, ``doc_id``, ``row_hash``, ``site`` (null as empty),
    ``n_lines`` and ``lines``, an array of (``no``, ``h``) of the lines with enough words."""
    text = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64("`text`", "`source`").alias("row_hash"),
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("site"),
        F.split(F.coalesce(F.col("`text`"), F.lit("")), "\n").alias("all"),
    )
    numbered = F.transform("all", lambda x, i: F.struct(i.alias("no"), x.alias("x")))
    long = F.filter(numbered, lambda s: F.size(words_of(s["x"])) >= LEAST_WORDS)
    rows = text.select(
        "doc_id", "row_hash", "site", F.size("all").cast("long").alias("n_lines"),
        F.transform(long, lambda s: F.struct(s["no"].alias("no"), line_hash(s["x"]).alias("h"))).alias("lines"),
    )
    return stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "lines")


def wide_lines(rows: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``h`` and ``first`` (its first place) of the lines on enough sites, from a ``line_table``."""
    each = rows.select("row_id", "doc_id", "site", F.explode("lines").alias("line")).select(
        "site", F.col("line.h").alias("h"),
        F.struct(
            F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", F.col("line.no").alias("no")
        ).alias("place"),
    )
    # a line that is in one place only is on one site
    spread = each.groupBy("h").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("place").alias("first"), F.count("*").alias("n")
    )
    spread = spread.where(F.col("n") >= least_sites).select(
        "h", "first", F.hll_sketch_estimate("sketch").alias("sites")
    )
    spread = stored(spread.where(F.col("sites") >= least_sites * (1 - MARGIN)), "spread")
    sure = spread.where(F.col("sites") > least_sites * (1 + MARGIN)).select("h", "first")
    near = spread.where(F.col("sites") <= least_sites * (1 + MARGIN)).select("h", "first")
    exact = (
        each.select("h", "site")
        .join(near.select("h"), "h", "left_semi")
        .distinct()
        .groupBy("h")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= least_sites)
    )
    return sure.unionAll(near.join(exact, "h", "left_semi").select("h", "first"))


def removals(rows: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """The rows of a ``line_table`` with ``removed``, the sorted numbers of their lines to remove."""
    wide = stored(wide_lines(rows, least_sites), "wide")
    each = rows.select("row_id", F.explode("lines").alias("line")).select("row_id", "line.no", "line.h")
    again = each.join(wide, "h").where(
        (F.col("row_id") != F.col("first.row_id")) | (F.col("no") != F.col("first.no"))
    )
    cut = again.groupBy("row_id").agg(F.sort_array(F.collect_list("no")).alias("removed"))
    none = F.expr("cast(array() as array<int>)")
    return rows.drop("lines").join(cut, "row_id", "left").withColumn("removed", F.coalesce("removed", none))


def line_dedup(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """All rows and columns of ``docs`` with their repeated cross-site lines taken out of ``text``.

    ``doc_id``, ``text`` and ``source`` are read. Null texts stay null, null sources are one site; lines
    of fewer than ``LEAST_WORDS`` words are never removed. Rows given twice are two places of their
    lines; as nothing tells them apart, both keep the lines that either keeps. A document may be left
    empty. An empty table gives an empty table.
    """
    each = removals(line_table(docs), least_sites).groupBy("doc_id", "row_hash")
    cut = each.agg(F.collect_set("removed").alias("sets")).select(
        "doc_id", "row_hash",
        F.aggregate("sets", F.get("sets", F.lit(0)), lambda a, x: F.array_intersect(a, x)).alias("removed"),
    )
    cut = stored(cut.where(F.size("removed") > 0), "removed")
    left = docs.select(
        F.struct("*").alias("row_"), F.col("`doc_id`").cast("long").alias("id_"),
        F.xxhash64("`text`", "`source`").alias("hash_"),
    )
    same = F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("hash_") == F.col("row_hash"))
    lines = F.split(F.col("row_.text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))[0]
    joined = left.join(cut, same, "left").withColumn(
        "text_", F.when(F.col("removed").isNull() | F.col("row_.text").isNull(), F.col("row_.text")).otherwise(text)
    )
    return joined.select(*(F.col("text_").alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many are removed, and their numbers (comma-joined)."""
    cut = removals(line_table(table(spark, sf_dir, "documents")))
    return cut.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


OP3_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as site, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (
  select doc_id, site, unnest(ls) as x, unnest(range(len(ls))) as no from d),
h as (
  select doc_id, site, no, ('0x' || substr(md5(regexp_replace(trim(regexp_replace(lower(x),
    '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')), 1, 15))::bigint as h
  from l where len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 3),
wide as (
  select h, min((doc_id, no)) as first from h group by h having count(distinct site) >= 8),
cut as (
  select doc_id, count(*) as n, string_agg(no::varchar, ',' order by no) as r
  from h join wide using (h) where (doc_id, no) <> first group by doc_id)
select d.doc_id, len(ls) as n_lines, coalesce(n, 0) as n_removed, coalesce(r, '') as removed_lines
from d left join cut using (doc_id)"""

QUERIES = {"op3_line_spread": op3_line_spread}
SQL = {"op3_line_spread": OP3_SQL}
