"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of digits as 0, runs of white space as one space) and hashed.
For each host (``source``) the distinct documents that hold a line are counted; a line above the limits
is removed from that host's documents, and a document that keeps too little is rejected.

Distinct documents are told apart by a digest of their distinct line hashes, in the count of a line as in
that of the host. Copies of one document (in any order of lines) thus count as one, and a document that was
copied often isn't mistaken for boilerplate; a banner amid different texts counts once for each text. Copies
with a line of their own are different documents.

One pass over the texts writes a row per document (its figures and line hashes); the rest works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import BLANK, stored, table, words_of

#: A line is boilerplate of its host if it is in so many distinct documents, and in this percentage.
LEAST_DOCS, LEAST_PERCENT = 5, 5
#: A document is depleted if fewer words, or a smaller percentage of its words, remain.
LEAST_WORDS, LEAST_KEPT_PERCENT = 10, 30
#: The base rules: words in a document, and the percentage of words in repeated windows of five.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of the normalised line, as a long (another engine can compute the same)."""
    plain = F.trim(F.regexp_replace(F.lower(line), BLANK, " "))
    return F.conv(F.substring(F.md5(F.regexp_replace(plain, "[0-9]+", "0")), 1, 15), 16, 10).cast("long")


def worded_lines(text: Column) -> Column:
    """The lines between line feeds that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def _repeated(grams: Column) -> Column:
    """How many words lie in windows that occur twice or more; ``grams`` has the hash of each window."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = F.transform(
        F.array(placed),
        lambda s: F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | (F.get(s, i + 1)["g"] == x["g"]),
        ),
    )[0]
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts, zero,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def _keys(docs: DataFrame) -> list[Column]:
    return [
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.xxhash64(F.col("`text`"), F.col("`source`")).alias("row_hash"),
    ]


def profile(docs: DataFrame) -> DataFrame:
    """A stored row per document: ``row_id``, ``doc_id``, ``row_hash``, ``host`` (null as empty), the base
    figures and ``lines``, an array of (``h``, words of the line)."""
    text = docs.select(
        *_keys(docs), F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("`text`"), F.lit("")).alias("text"),
    )
    split = text.withColumns({"words": words_of(F.col("text")), "raw": worded_lines(F.col("text"))})
    last = F.size("words") - WINDOW
    w = F.col("words")
    split = split.withColumn(
        "grams",
        F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
        ),
    )
    figures = split.select(
        "doc_id", "row_hash", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _repeated(F.col("grams")))
        .otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform(
            "raw", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))
        ).alias("lines"),
    )
    return stored(figures.withColumn("row_id", F.monotonically_increasing_id()), "profile")


def frequent_lines(
    rows: DataFrame, least_docs: int = LEAST_DOCS, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """``host``, ``h``, ``n_docs`` of the lines above both limits, from a ``profile``."""
    sets = rows.select("host", F.sort_array(F.array_distinct("lines.h")).alias("hs"))
    sets = sets.withColumn("digest", F.xxhash64("hs"))
    held = sets.select("host", F.explode("hs").alias("h"), "digest").distinct()
    counted = held.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    texts = sets.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    return (
        counted.join(texts, "host")
        .where(F.col("n_docs") * 100 >= F.col("n_texts") * least_percent)
        .select("host", "h", "n_docs")
    )


def verdicts(rows: DataFrame, **limits: int) -> DataFrame:
    """The rows of a ``profile`` with ``removed`` (hashes of their boilerplate lines), ``n_left`` (words
    that remain), ``base_failed``, ``depleted`` and ``kept``."""
    frequent = frequent_lines(rows, **limits)
    cut = (
        rows.select("row_id", "host", F.explode("lines").alias("line"))
        .select("row_id", "host", "line.h", "line.n")
        .join(frequent.select("host", "h"), ["host", "h"])
        .groupBy("row_id")
        .agg(F.collect_set("h").alias("removed"), F.sum("n").alias("gone"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    depleted = (F.col("n_left") < LEAST_WORDS) | (
        F.col("n_left") * 100 < F.col("n_words") * LEAST_KEPT_PERCENT
    )
    return (
        rows.drop("lines")
        .join(cut, "row_id", "left")
        .withColumns({"n_left": F.col("n_words") - F.coalesce("gone", F.lit(0)), "base_failed": base})
        .withColumn("depleted", depleted)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def quality_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents that pass, without their host's boilerplate lines; all columns of ``docs``.

    ``doc_id``, ``text`` and ``source`` are read. A null text has no words and is rejected by the base
    rules; a null source is the host ``''``; a null ``doc_id`` is kept as it is. Repeated rows get the
    same verdict and all stay or go. ``n_chars``, if present, follows the new text. An empty table gives
    an empty table.
    """
    judged = stored(verdicts(profile(docs), **limits).select("doc_id", "row_hash", "removed", "kept"), "judged")
    judged = judged.where("kept").drop("kept").dropDuplicates(["doc_id", "row_hash"])
    right = judged.select(F.col("doc_id").alias("id_r"), F.col("row_hash").alias("hash_r"), "removed")
    left = docs.select(F.struct("*").alias("row_"), *_keys(docs))
    kept = left.join(
        right, F.col("doc_id").eqNullSafe(F.col("id_r")) & (F.col("row_hash") == F.col("hash_r"))
    )
    lines = F.filter(
        F.split(F.col("row_.text"), "\n"),
        lambda x: ~(x.rlike(_WORD) & F.array_contains(F.col("removed"), line_hash(x))),
    )
    text = F.when(F.col("removed").isNull(), F.col("row_.text")).otherwise(F.array_join(lines, "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("removed").isNull(), F.col("row_.n_chars")).otherwise(
            F.length(text).cast(kind)
        )
    return kept.select(*(changed.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(profile(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_left",
    )


OP2_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t
  from documents),
w as (
  select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from d),
p as (select rid, unnest(ws) as x, unnest(range(len(ws))) as i from w),
g as (
  select rid, i, x || ' ' || lead(x, 1) over r || ' ' || lead(x, 2) over r || ' ' || lead(x, 3) over r
         || ' ' || lead(x, 4) over r as g
  from p window r as (partition by rid order by i)),
covered as (
  select rid, count(distinct spot) as n from (
    select rid, unnest(range(i, i + 5)) as spot from (
      select rid, i, count(*) over (partition by rid, g) as c from g where g is not null) where c > 1)
  group by rid),
l as (
  select rid, host, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) as n,
    ('0x' || substr(md5(regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')),
      '[0-9]+', '0', 'g')), 1, 15))::bigint as h
  from (select rid, host, unnest(ls) as x from w)),
hs as (
  select host, coalesce(list_sort(list_distinct(list(h) filter (h is not null))), []) as hs
  from d left join (select rid, h from l) using (rid) group by rid, host),
sets as (select distinct host, hs from hs),
frequent as (
  select host, h from (
    select host, h, count(*) as n_docs from (select host, unnest(hs) as h from sets) group by all)
  join (select host, count(*) as n_texts from sets group by host) using (host)
  where n_docs >= 5 and n_docs * 100 >= n_texts * 5),
gone as (select rid, sum(n) as gone from l semi join frequent using (host, h) group by rid),
f as (
  select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
         len(ws) - coalesce(gone, 0)::bigint as n_left
  from w left join covered using (rid) left join gone using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_left >= 10 and 100 * n_left >= 30 * n_words as kept, n_left
from b"""

QUERIES = {"op2_line_frequency": op2_line_frequency}
SQL = {"op2_line_frequency": OP2_SQL}
