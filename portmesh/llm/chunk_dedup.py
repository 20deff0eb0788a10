"""Substring de-duplication with content-defined chunks.

A gear hash rolls over the words of a text: each step shifts it left and adds the word's random number, so
its low bits depend on the last few words only. Where they fall below a limit a chunk ends; white space of
any kind only separates words. An insertion or another line break thus changes the chunks around it and no
others, and a passage that stands in two documents has the same inner chunks in both, whatever surrounds it.

Chunks are short, and common ones stand in many unrelated texts. What is looked up is therefore a stretch:
as many chunks from one on as hold ``LEAST_WORDS`` words, by a 128-bit digest of their digests. A stretch
that came before stood there as a whole, so no passage is put together from chunks of different places.

Texts are chunked once and their stretches stored. Half of each digest is counted; stretches whose half came
up again are matched in full, the first place (least document, then place) of each is found, and later ones
that overlap or touch are joined to passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portmesh.llm.common import columns_of, mix, stored, table, word_hashes

#: A chunk ends where the gear hash modulo ``SPACE`` is below ``CUTS``; on average after SPACE / CUTS words.
SPACE, CUTS = 16, 3
#: A chunk ends at the latest after so many words.
LONGEST = 64
#: Words that a stretch of chunks holds at least, and so a repeated passage. A passage shared by two texts
#: loses the words before its first cut, at most two chunks at its end, and is missed only if its first and
#: last cut lie closer together than this. 16 is the most for which that is so in fewer than 1 of 100
#: passages of 51 words; a shared sentence of fewer words is no passage.
LEAST_WORDS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gear(hashes: np.ndarray, bits: int = 4) -> np.ndarray:
    """The low ``bits`` of the gear hash after each word: the last ``bits`` words count, each shifted once
    for every later one."""
    numbers = mix(hashes + _ODD)
    total = numbers.copy()
    for k in range(1, bits):
        total[k:] += numbers[:-k] << np.uint64(k)
    return total & np.uint64((1 << bits) - 1)


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and the two halves of the digest of each chunk, then its words by the next chunk's
    start; the first array has one more entry, the number of words."""
    data = (text or "").lower().encode("utf-8", "replace")
    hashes = word_hashes(data)[0]
    n = len(hashes)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    cut = gear(hashes, SPACE.bit_length() - 1) < CUTS
    cut[-1] = True
    bounds = np.concatenate([[0], np.flatnonzero(cut) + 1])
    if (np.diff(bounds) > LONGEST).any():
        bounds = np.unique(
            np.concatenate([bounds, *(np.arange(a, b, LONGEST) for a, b in zip(bounds[:-1], bounds[1:], strict=True))])
        )
    at = bounds[:-1]
    place = np.arange(n) - np.repeat(at, np.diff(bounds))
    # two sums of word hashes, each mixed with the word's place in the chunk by another rule
    one = np.add.reduceat(mix(hashes + (place + 1).astype(np.uint64) * _ODD), at)
    two = np.add.reduceat(mix(~hashes ^ ((place + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), at)
    return bounds, mix(one), mix(two)


def stretches_of(text: str | None, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """The stretches of a text, one from each chunk on that is followed by enough words: first chunk, chunk
    behind the last, first word, number of words, and the two halves of the digest."""
    bounds, *halves = chunks_of(text)
    no = np.arange(len(bounds) - 1)
    upto = np.searchsorted(bounds, bounds[:-1] + max(least_words, 1))
    no, upto = no[upto < len(bounds)], upto[upto < len(bounds)]
    digests = []
    for half in halves:
        total = np.zeros(len(no), np.uint64)
        for k in range(int((upto - no).max(initial=0))):
            inside = no + k < upto
            total[inside] = total[inside] * _ODD + half[no[inside] + k]
        digests.append(mix(total))
    return no, upto, bounds[no], bounds[upto] - bounds[no], *digests


_DDL = "doc_id long, t long, no int, upto int, at int, words int, d1 long, d2 long"
_STRETCHES = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int64()), ("no", pa.int32()), ("upto", pa.int32()), ("at", pa.int32()),
     ("words", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]
)


def _stretches(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [stretches_of(x.as_py(), least_words) for x in batch.column(2)]
        row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
        flat = [np.concatenate(x) for x in zip(*found, strict=True)]
        columns = [pa.array(x.astype(np.int32)) for x in flat[:4]] + [pa.array(x.view(np.int64)) for x in flat[4:]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns], schema=_STRETCHES)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row per repeated passage: ``doc_id``, ``t`` (hash of the text), ``start_word``, ``n_words``,
    ``n_chunks`` and ``first_doc_id`` (least document in which one of its stretches stands first).

    ``doc_id`` and ``text`` are read. The first place of each stretch is never part of a passage, and so
    neither is the first place of a chunk, unless a text repeats itself in steps shorter than a stretch: then
    one step stays. Places are ordered by ``doc_id`` (nulls last), text hash and place. A passage repeated
    within one document counts. Null and empty texts and those of fewer than ``least_words`` words have no
    stretches; rows given twice (same ``doc_id`` and text) count as one. An empty table gives no rows.
    """
    text = columns_of(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"
    )
    every = stored(text.mapInArrow(partial(_stretches, least_words=least_words), _DDL), "stretches", compression="zstd")
    again = every.groupBy("d1").count().where("count > 1").select("d1")
    # rows given twice need no removal: their stretches stand in one place, and overlap in a passage
    found = stored(every.join(again, "d1", "left_semi"), "again", compression="zstd")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "no")
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table of its own: the rows of a very common stretch can then be split in the join
    first = stored(first.drop("n"), "first")
    later = found.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    # stretches that overlap or touch are one passage; their ends rise with their starts
    order = Window.partitionBy("doc_id", "t").orderBy("no")
    apart = F.coalesce(F.col("at") > F.lag(F.col("at") + F.col("words")).over(order), F.lit(True))
    runs = later.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("long")).over(order))
    return (
        runs.groupBy("doc_id", "t", "run")
        .agg(
            F.min("at").cast("long").alias("start_word"),
            (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("n_words"),
            (F.max("upto") - F.min("no")).cast("long").alias("n_chunks"),
            F.min("first.doc_id").alias("first_doc_id"),
        )
        .drop("run")
    )


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the words of their repeated ``passages`` taken out of ``text``; all rows and columns.

    A text without passages is as before. In others the words that stay keep the white space before them.
    """
    spans = passages.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    rows = docs.select(
        F.struct("*").alias("row_"), F.col("`doc_id`").cast("long").alias("id_"), F.xxhash64("`text`").alias("t_")
    )
    same = F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("t_") == F.col("t"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, _cut)

    left = rows.join(spans, same, "left").withColumn(
        "text_", F.when(F.col("spans").isNull(), F.col("row_.text")).otherwise(cut("row_.text", "spans"))
    )
    return left.select(*(F.col("text_").alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns))


def _cut(text, spans):
    if spans is None or text is None:
        return text
    data = text.encode("utf-8", "replace")
    _, starts, ends = word_hashes(data)
    keep = np.ones(len(starts), bool)
    for span in spans:
        keep[span["start_word"] : span["start_word"] + span["n_words"]] = False
    before = np.concatenate([[0], ends[:-1]])
    parts = [data[before[i] : ends[i]] for i in np.flatnonzero(keep)]
    return (b"".join(parts) + data[ends[-1] :]).decode("utf-8")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("t")


QUERIES = {"op6_chunk_dedup": op6_chunk_dedup}
SQL: dict[str, str] = {}
