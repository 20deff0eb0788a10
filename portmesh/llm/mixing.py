"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in a pseudo-random order, form blocks. A source of weight w (of all weights) releases its block k
(from 0) at slot floor(k / w) and wants it placed by slot ceil((k + 1) / w). Each slot takes, of the
released blocks, one with the earliest deadline. As the weights add up to 1, each source has its share of the slots up
to any of them to within less than one block.

Slots are cut into stretches of ``STRETCH``, which are scheduled on their own. Which blocks a stretch gets follows from a
binary tree over the sources: a node deals its places to its two children in proportion to their weights, with rounding to the nearest, so a
block's place, and with it its stretch, is worked out from its number going up the tree, in whole
numbers. Sources stand in the tree in order of their weights, so that the two children of a node weigh about the same, and a
share is off by about half a block, half of that from the node above, and so on. So there may be any number of sources
and blocks. At the border of two stretches a block may have to go just outside its window; the README has figures.

When a source runs out, the others close up, keeping their weights among themselves. Every document gets a place; none
is dropped or repeated. Sources of weight 0 come after all the others.

A document's number in its source comes from counts of hash ranges and a window within one range, so a
source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portmesh.llm.common import stored, table

#: Slots that are scheduled together.
STRETCH = 256
#: Documents of a block.
BLOCK = 16
#: Target weight of a source when none is given: its number of documents to this power.
TEMPERATURE = 0.7
#: Rows of a hash range, about; with more than 2 ** MOST_BITS ranges they get larger instead, so that a
#: source's table of ranges, which one task adds up, stays bounded.
RANGE_ROWS, MOST_BITS = 1024, 17
#: Weights are whole numbers, this often in the sum of all; a positive weight is at least 1.
UNITS = 1 << 30
#: Where sources of weight 0 begin.
AFTER_ALL = 1 << 61

_BITS = 60
#: Levels of the tree: enough to tell two places in the sum of all weights apart.
_LEVELS = 32


def _order(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 of id and text: the pseudo-random place within the source."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def units_of(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``src``, ``n`` and ``units``, the weight as a whole number, of each source (``src``, ``n``)."""
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(TEMPERATURE))
    else:
        known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))
        weight = F.greatest(F.coalesce(F.get(F.array(known[F.col("src")]), F.lit(0)).cast("double"), F.lit(0.0)), F.lit(0.0))
    x = counts.withColumn("w", weight)
    total = x.agg(F.sum("w")).first()[0] or 1.0
    units = F.greatest(F.lit(1), F.round(F.col("w") / total * UNITS).cast("long"))
    return x.select("src", "n", F.when(F.col("w") > 0, units).otherwise(0).alias("units"))


def _paths(units: DataFrame, sources: int, total: int) -> DataFrame:
    """``src``, ``units`` and ``path``: for each node of the tree above a source, from the source to the root,
    whether it is the second child, its weight and the node's."""
    bits = (sources // RANGE_ROWS).bit_length()
    x = units.withColumns({
        "size": F.length(F.bin("units")), "top": F.substring(F.bin("units"), 1, 3),
        "h": F.conv(F.substring(F.md5("src"), 1, 15), 16, 10).cast("long"),
    }).withColumn("part", F.shiftright("h", _BITS - bits))
    part = [F.desc("size"), F.desc("top"), "part"]
    # a row for about a thousand sources
    parts = x.groupBy("size", "top", "part").agg(F.sum("units").alias("u"))
    earlier = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("u", F.coalesce(F.sum("u").over(earlier), F.lit(0)))
    inside = Window.partitionBy("size", "top", "part").orderBy("h", "src").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.coalesce(F.sum("units").over(inside), F.lit(0))).join(parts, ["size", "top", "part"])
    at = F.expr(f"cast(2 * (u + own) + units as decimal(20, 0)) * {1 << _LEVELS}BD div {2 * total}BD")
    x = stored(x.select("src", "units", at.alias("at")), "places")
    nodes = x.select("src", "units", "at", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("level"))
    nodes = nodes.withColumn("node", F.expr(f"shiftright(at, {_LEVELS} - level)"))
    sums = stored(nodes.groupBy("level", "node").agg(F.sum("units").alias("a")), "nodes")
    above = sums.select((F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("a").alias("b"))
    steps = nodes.where("level > 0").join(sums, ["level", "node"]).withColumn("parent", F.shiftright("node", 1))
    steps = steps.join(above, ["level", "parent"]).where("a < b")
    step = F.struct(-F.col("level"), F.col("node").bitwiseAND(1).alias("side"), "a", "b")
    found = steps.groupBy("src").agg(F.sort_array(F.collect_list(step)).alias("path"))
    none = F.array().cast("array<struct<col1: int, side: long, a: long, b: long>>")
    return x.select("src", "units").join(found, "src", "left").withColumn("path", F.coalesce("path", none))


#: The place of a node's item among its parent's, going up.
_UP = """
aggregate(path, block, (n, s) -> case when s.side = 0
  then ((2 * cast(n as decimal(20, 0)) + 1) * cast(s.b as decimal(12, 0)) + 2 * s.a - 1) div (2 * cast(s.a as decimal(12, 0))) - 1
  else (2 * cast(n as decimal(20, 0)) + 1) * cast(s.b as decimal(12, 0)) div (2 * cast(s.a as decimal(12, 0))) end)"""

#: Earliest deadline first over one stretch; jobs stand in order of their deadlines. When none is released, the one that will
#: be first is taken.
_EDF = """
aggregate(sequence(0, size(jobs) - 1),
  named_struct('jobs', jobs, 'done', cast(array() as array<struct<deadline: long, src: string, release: long, block: long>>)),
  (s, i) -> transform(
    array(coalesce(get(filter(s.jobs, x -> x.release <= first + i), 0),
                   get(array_sort(s.jobs, (x, y) -> case when x.release < y.release then -1 when x.release > y.release then 1 else 0 end), 0))),
    t -> named_struct('jobs', filter(s.jobs, x -> x <> t), 'done', concat(s.done, array(t))))[0],
  s -> s.done)"""


def schedule(blocks: DataFrame, units: DataFrame, sources: int, stretch: int = STRETCH) -> DataFrame:
    """``src``, ``block``, ``release``, ``deadline`` and ``slot`` of each block (``src``, ``block``) of sources of
    positive weight (``src``, ``units``)."""
    total = units.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    paths = stored(_paths(units, sources, max(total, 1)), "paths")
    jobs = blocks.join(paths, "src").select(
        "src", "block", F.expr(f"({_UP}) div {stretch}").alias("stretch"),
        F.expr(f"cast(block as decimal(20, 0)) * {total}BD div units").alias("release"),
        F.expr(f"((block + 1) * {total}BD + units - 1) div units").alias("deadline"),
    )
    # a stretch has as many blocks as slots at most
    together = jobs.groupBy("stretch").agg(
        F.sort_array(F.collect_list(F.struct("deadline", "src", "release", "block"))).alias("jobs")
    )
    first = F.col("stretch") * stretch
    placed = together.withColumn("first", first).select("first", F.posexplode(F.expr(_EDF)).alias("i", "x"))
    return placed.select("x.src", "x.block", "x.release", "x.deadline", (F.col("first") + F.col("i")).alias("slot"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``src``, ``row_hash``, ``block``, ``release``, ``deadline``,
    ``slot`` and ``place`` (within the block). (``slot``, ``place``) is the order of the mix.

    ``doc_id``, ``source`` and ``text`` (for the order within a source) are read. Null sources are the
    source ``''``. Rows with the same or no ``doc_id`` each get a place. ``weights`` are relative, by
    source; sources without one, or with one of 0, come after all the others, mixed evenly, with slots from
    ``AFTER_ALL``. An empty table gives no rows. Any number of sources will do.
    """
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("src"),
        F.xxhash64("`text`").alias("row_hash"),
        _order(F.col("`doc_id`"), F.col("`text`")).alias("h"),
    )
    rows = stored(rows, "order")
    counts = stored(rows.groupBy("src").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, (total // RANGE_ROWS).bit_length())
    rows = rows.withColumn("part", F.shiftright("h", _BITS - bits).cast("long"))
    sizes = stored(rows.groupBy("src", "part").agg(F.count("*").alias("m")), "sizes")
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("src", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "part").orderBy("h", "doc_id", "row_hash")
    numbered = rows.withColumn("i", F.row_number().over(inside)).join(sizes, ["src", "part"])
    rank = F.col("before") + F.col("i") - 1
    numbered = numbered.select(
        "doc_id", "src", "row_hash", F.floor(rank / block).cast("long").alias("block"), (rank % block).cast("long").alias("place")
    )
    numbered = stored(numbered, "numbered")
    blocks = numbered.where("place = 0").select("src", "block")
    units = stored(units_of(counts, weights), "units")
    known, unknown = (units.where(c).select("src", "units") for c in ("units > 0", "units = 0"))
    n_known, n_unknown = units.agg(F.count_if(F.col("units") > 0), F.count_if(F.col("units") == 0)).first()
    slots = schedule(blocks, known, n_known, stretch)
    if n_unknown:
        rest = schedule(blocks, unknown.withColumn("units", F.lit(1).cast("long")), n_unknown, stretch)
        slots = slots.unionByName(rest.withColumns({c: F.col(c) + AFTER_ALL for c in ("release", "deadline", "slot")}))
    return numbered.join(slots, ["src", "block"]).select(
        "doc_id", "src", "row_hash", "block", "release", "deadline", "slot", "place"
    )


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """All rows and columns of ``docs``, sorted by their place in the mix: written to files, file after
    file is the mixed stream. Rows that are alike in id, source and text are next to each other."""
    order = stored(
        mixed(docs, **how).groupBy("doc_id", "src", "row_hash").agg(F.min(F.struct("slot", "place")).alias("at")),
        "mixed",
    )
    left = docs.select(
        F.struct("*").alias("row_"), F.col("`doc_id`").cast("long").alias("id_"),
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("src_"), F.xxhash64("`text`").alias("t_"),
    )
    same = (
        F.col("id_").eqNullSafe(F.col("doc_id"))
        & (F.col("src_") == F.col("src"))
        & (F.col("t_") == F.col("row_hash"))
    )
    return left.join(order, same).orderBy("at.slot", "at.place").select("row_.*")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("src").alias("source"), "block", "release", "deadline", "slot", "place"
    )


OP5_SQL = """
with recursive d as (
  select doc_id, coalesce(source, '') as src,
         md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')))[1:15] as h from documents),
c as (select src, count(*) as n, pow(count(*), 0.7::double) as w from d group by src),
u as (select src, n, greatest(1, round(w / sum(w) over () * 1073741824))::bigint as units from c),
o as (select *, sum(units) over () as total,
             sum(units) over (order by length(bin(units)) desc, bin(units)[1:3] desc, md5(src)[1:15], src) - units as own from u),
p as (select src, units, total, ((2 * own + units)::hugeint * 4294967296 // (2 * total))::bigint as spot from o),
nodes as (select src, units, level, spot >> (32 - level)::int as node from p, range(33) r(level)),
sums as (select level, node, sum(units) as a from nodes group by all),
steps as (
  select n.src, row_number() over (partition by n.src order by n.level desc) as i, n.node & 1 as side,
         s.a::hugeint as a, t.a::hugeint as b
  from nodes n join sums s on s.level = n.level and s.node = n.node
  join sums t on t.level = n.level - 1 and t.node = n.node >> 1 where s.a < t.a),
ranked as (select doc_id, src, row_number() over (partition by src order by h, doc_id) - 1 as rk from d),
blocks as (select distinct src, rk // 16 as block from ranked),
up(src, block, i, n) as (
  select src, block, 0::bigint, block::hugeint from blocks
  union all
  select u.src, u.block, s.i, case when s.side = 0 then ((2 * n + 1) * b + 2 * a - 1) // (2 * a) - 1 else (2 * n + 1) * b // (2 * a) end
  from up u join steps s on s.src = u.src and s.i = u.i + 1),
jobs as (
  select src, block, (arg_max(n, i) // 256)::bigint as stretch, (block::hugeint * any_value(total) // any_value(units))::bigint as release,
         (((block + 1)::hugeint * any_value(total) + any_value(units) - 1) // any_value(units))::bigint as deadline
  from up join p using (src) group by src, block),
edf(stretch, i, jobs, best) as (
  select stretch, -1::bigint, list({'deadline': deadline, 'src': src, 'release': release, 'block': block}
                           order by deadline, src, release, block), null::struct(deadline bigint, src varchar, release bigint, block bigint)
  from jobs group by stretch
  union all
  select stretch, i + 1, list_filter(jobs, lambda x: x <> best), best from (
    select stretch, i, jobs, coalesce(list_filter(jobs, lambda x: x.release <= stretch * 256 + i + 1)[1],
      list_filter(jobs, lambda x: x.release = list_min(list_transform(jobs, lambda y: y.release)))[1]) as best
    from edf where len(jobs) > 0)),
slots as (select best.src as src, best.block as block, best.release as release, best.deadline as deadline,
                 stretch * 256 + i as slot from edf where i >= 0)
select doc_id, src as source, block, release, deadline, slot, rk % 16 as place
from ranked r join slots s using (src) where s.block = r.rk // 16"""

QUERIES = {"op5_pfair_mix": op5_pfair_mix}
SQL = {"op5_pfair_mix": OP5_SQL}
