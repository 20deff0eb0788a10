"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. The steps:

1. One pass hashes each text to a class (texts with the same shingle set are one class) and to MinHash
   bands; the result, a few hundred bytes per document, is stored.
2. Classes that share a band are candidates. A band links each of its classes to the band's least class
   only, so that a band of n classes gives n - 1 links; the components of these links hold every
   candidate pair.
3. A component's texts meet in tasks of bounded bytes: a large component is split into blocks, and each
   pair of blocks is one task. There, fresh MinHash values are compared some at a time for all pairs at
   once; a pair goes when the posterior probability that its similarity reaches the threshold falls below
   the tolerance. The rest are verified exactly on the shingle sets.
4. A task returns a row per class: how many documents it is linked to, and its root among the task's
   links. Links add up over tasks, and the components of the roots are the groups.

No pair is ever a row. Copies of one text are one class and never form pairs.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import columns_of, mix, shingles, stored, table
from portmesh.llm.components import components

THRESHOLD = 0.8
WIDTH = 5
BANDS, ROWS = 32, 6
TOLERANCE = 1e-6
STEP, STEPS = 16, 8
BLOCK_BYTES = 2_000_000


@lru_cache(maxsize=8)
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    keys = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return (keys[:n] | np.uint64(1)).astype(np.uint32), (keys[n:] >> np.uint64(32)).astype(np.uint32)


def minhash(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` MinHash values (uint32) of a set of 64-bit hashes, some hundred members at a time."""
    factor, offset = _functions(n, seed)
    low = (mix(values ^ np.uint64(seed * 0x9E3779B9)) >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, (low[at : at + 512, None] * factor + offset).min(axis=0), out=best)
    return best


def least_matches(threshold: float, tolerance: float, step: int = STEP, steps: int = STEPS) -> list[int]:
    """After n = step, 2 step, … compared values: the fewest matches that a pair needs to stay.

    With a uniform prior, the similarity after m matches among n values has a Beta(m + 1, n - m + 1)
    posterior, and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, step * steps + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _sign(width: int, bands: int, rows: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("t", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
         ("n", pa.int32()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )
    salt = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(48)

    def run(batches):
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            c1, c2, n, size, out = [], [], [], [], []
            for cell in texts:
                text = cell.as_py()
                own = shingles(text, width)
                n.append(len(own))
                size.append(len(text or ""))
                if not len(own):
                    c1.append(None), c2.append(None), out.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                c1.append(int(digest[0])), c2.append(int(digest[1]))
                least = minhash(own, bands * rows, 1).reshape(bands, rows).astype(np.uint64)
                key = salt.copy()
                for k in range(rows):
                    key = mix(key * np.uint64(31) + least[:, k])
                out.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document, stored: ``doc_id``, ``t`` (hash of the text), the class ``c1``, ``c2`` (null
    for a text without words), ``n`` shingles, ``size`` in characters and the band keys."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return stored(
        text.mapInArrow(
            _sign(width, bands, rows),
            "doc_id long, t long, c1 long, c2 long, n int, size long, bands array<long>",
        ),
        "signed",
    )


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``node``, ``root`` of the classes that share a band with another one."""
    bands = classes.select("c1", F.explode("bands").alias("band"))
    shared = (
        bands.groupBy("band")
        .agg(F.min("c1").alias("hub"), F.max("c1").alias("top"))
        .where("hub <> top")
        .select("band", "hub")
    )
    links = bands.join(shared, "band").where("c1 <> hub").select(F.col("c1").alias("a"), F.col("hub").alias("b"))
    return components(links)


def _links(threshold: float, tolerance: float, width: int):
    need = least_matches(threshold, tolerance)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["c1", "c2"], kind="stable").drop_duplicates(["c1", "c2"])
        own = [shingles(t, width) for t in pdf["text"]]
        count = np.array([len(x) for x in own])
        signs = np.stack([minhash(x, STEP * STEPS, 2) for x in own])
        # ids of the shingles within this task, all texts one after the other
        flat = np.unique(np.concatenate(own), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        member = np.zeros(int(flat.max()) + 1, np.int32)
        block, copies = pdf["block"].to_numpy(), pdf["copies"].to_numpy()
        cross = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        n = len(own)
        linked_docs, linked = np.zeros(n, np.int64), np.zeros(n, np.int64)
        root = np.arange(n)

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            if cross:
                rest = rest[block[rest] != block[i]]
            # sizes too different for the threshold
            low = np.minimum(count[rest], count[i])
            rest = rest[low >= threshold * (np.maximum(count[rest], count[i])) - 1e-9]
            matches = np.zeros(len(rest), np.int64)
            for k, least in enumerate(need):
                if not len(rest):
                    break
                part = slice(k * STEP, (k + 1) * STEP)
                matches += (signs[rest, part] == signs[i, part]).sum(axis=1)
                stay = matches >= least
                rest, matches = rest[stay], matches[stay]
            if not len(rest):
                continue
            mine = flat[starts[i] : starts[i] + count[i]]
            member[mine] = 1
            if len(rest) * 4 > n:
                shared = np.add.reduceat(member[flat], starts)[rest]
            else:
                shared = np.array([member[flat[starts[j] : starts[j] + count[j]]].sum() for j in rest])
            member[mine] = 0
            # shared / union >= threshold, with room for rounding of the product only
            sure = shared >= threshold * (count[rest] + count[i] - shared) - 1e-9
            for j in rest[sure]:
                root[find(j)] = find(i)
            rest = rest[sure]
            linked[rest] += 1
            linked_docs[rest] += copies[i]
            linked[i] += len(rest)
            linked_docs[i] += copies[rest].sum()
        roots = np.array([find(i) for i in range(n)])
        c1 = pdf["c1"].to_numpy()
        hit = linked > 0
        return pd.DataFrame(
            {"c1": c1[hit], "c2": pdf["c2"].to_numpy()[hit], "root": c1[roots][hit],
             "links": linked_docs[hit], "classes": linked[hit]}
        )

    return run


def linked_classes(
    docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH
) -> DataFrame:
    """Stored rows ``c1``, ``c2``, ``root``, ``links`` (documents), ``classes`` of each class and task that
    verified a link. Of a class's texts only that of its first row is read."""
    groups = candidate_groups(classes)
    nodes = classes.drop("bands").join(groups, F.col("c1") == F.col("node")).drop("node")
    blocks = nodes.groupBy("root").agg(F.ceil(F.sum(F.col("size") + 64) / BLOCK_BYTES).cast("int").alias("blocks"))
    nodes = nodes.join(blocks, "root").withColumn(
        "block", F.pmod(F.xxhash64("c1", "c2"), F.col("blocks")).cast("int")
    )
    nodes = nodes.withColumns({"t": F.col("first.t"), "first_id": F.col("first.doc_id")})
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t_"), "text")
    wanted = nodes.select("first_id", "t").distinct()
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("t_") == F.col("t"))
    texts = texts.join(wanted, same, "left_semi").groupBy("t_").agg(F.any_value("text").alias("text"))
    tasks = nodes.join(texts, F.col("t") == F.col("t_")).select(
        "root", "c1", "c2", "copies", "block", "text",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}
    ).drop("other")
    found = tasks.groupBy("root", "lo", "hi").applyInPandas(
        _links(threshold, tolerance, width), "c1 long, c2 long, root long, links long, classes long"
    )
    return stored(found, "linked")


def classes_of(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH
) -> tuple[DataFrame, DataFrame]:
    """The ``signed`` rows, and a stored row per class: ``c1``, ``c2``, ``first`` (of its rows, by
    ``doc_id``, nulls last, then ``t``), ``n_copies``, ``n_links``, ``group`` and ``class_id`` (least
    ``doc_id`` of the group)."""
    sign = signed(docs, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    classes = (
        sign.where("c1 is not null")
        .groupBy("c1", "c2")
        .agg(
            F.count("*").alias("copies"), first, F.any_value("size").alias("size"),
            F.any_value("bands").alias("bands"),
        )
    )
    classes = stored(classes, "classes")
    found = linked_classes(docs, classes, threshold, tolerance, width)
    links = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("c1").alias("a"), F.col("root").alias("b")))
    grouped = (
        classes.drop("bands", "size")
        .join(links, ["c1", "c2"], "left")
        .join(groups, F.col("c1") == F.col("node"), "left")
        .select(
            "c1", "c2", "first", F.col("copies").alias("n_copies"), F.coalesce("root", "c1").alias("group"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    least = grouped.groupBy("group").agg(F.min("first.doc_id").alias("class_id"))
    return sign, stored(grouped.join(least, "group"), "grouped")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH
) -> DataFrame:
    """A row per row of ``docs`` (columns ``doc_id`` and ``text`` are read, others ignored):

    ``doc_id``, ``t`` (hash of the text), ``group`` (null for a text without words), ``class_id`` (least
    ``doc_id`` of the group; the row's own without one), ``n_copies`` (rows with the same shingle set,
    itself included) and ``n_links`` (other rows at or above the threshold, copies included).

    Words are lower-cased runs of non-blank characters. Null and empty texts have no shingles, join
    nothing and have 0 links. Repeated rows are copies of each other. An empty table gives no rows.
    """
    sign, classes = classes_of(columns_of(docs, "doc_id", "text"), threshold, tolerance, width)
    # both sides are tables: a class with a large part of all rows can be split in the join
    return (
        sign.select("doc_id", "t", "c1", "c2")
        .join(classes.drop("first"), ["c1", "c2"], "left")
        .select(
            "doc_id", "t", "group", F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group: the one of the least ``doc_id`` (nulls last), then
    text hash, stays. Texts without words all stay."""
    sign, classes = classes_of(columns_of(docs, "doc_id", "text"))
    keep = stored(classes.groupBy("group").agg(F.min("first").alias("k")).select("k.doc_id", "k.t"), "keep")
    rest = docs.select(F.struct("*").alias("row_"), F.xxhash64(F.col("`text`")).alias("t_")).withColumn(
        "id_", F.col("row_.doc_id").cast("long")
    )
    kept = rest.join(keep, (F.col("t_") == F.col("t")) & F.col("id_").eqNullSafe(F.col("doc_id")))
    repeated = sign.where("c1 is not null").groupBy("doc_id", "t").count().where("count > 1")
    if not repeated.isEmpty():  # rows given twice: one of them stays
        kept = kept.dropDuplicates(["id_", "t_"])
    blank = sign.where("c1 is null").select("t").distinct()
    empty = rest.join(blank, F.col("t_") == F.col("t"), "left_semi")
    return kept.select("row_.*").unionByName(empty.select("row_.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``class_id`` (least ``doc_id`` of its group of linked documents; its own if
    it has none), ``n_copies`` and ``n_links``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


OP9_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') as ws from documents),
p as (select doc_id, unnest(ws) as x, unnest(range(len(ws))) as i from w where len(ws) >= 5),
s as (
  select distinct doc_id, sh from (
    select doc_id, x || ' ' || lead(x, 1) over r || ' ' || lead(x, 2) over r || ' ' || lead(x, 3) over r
           || ' ' || lead(x, 4) over r as sh
    from p window r as (partition by doc_id order by i)) where sh is not null
  union all
  select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n, md5(string_agg(sh, chr(10) order by sh)) as own from s group by doc_id),
c as (select own, count(*) as n_copies from n group by own),
links as materialized (
  select x, y from (
    select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id)
  join n nx on nx.doc_id = x join n ny on ny.doc_id = y where k >= 0.8 * (nx.n + ny.n - k) - 1e-9),
reach(doc_id, r) as (
  select doc_id, doc_id from w union select y, r from reach join links on x = doc_id),
result as materialized (
  select w.doc_id, min(r) as class_id, coalesce(any_value(n_copies), 1) as n_copies,
         coalesce(any_value(m), 0) as n_links
  from w join reach on reach.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
  left join c on c.own = n.own
  left join (select x, count(*) as m from links group by x) l on l.x = w.doc_id
  group by w.doc_id)
select * from result"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL = {"op9_jaccard_join": OP9_SQL}
