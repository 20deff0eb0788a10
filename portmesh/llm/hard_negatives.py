"""Hard negatives by threshold joins with norm bounds.

For each anchor, the best rows of its label are its positives; around each positive's score lies a window
in which the best rows of other labels are hard negatives. Both are searches for the best few rows whose score
lies between two numbers, and both run as threshold joins:

* Rows are cut into blocks. A block has an inverted index over its dimensions, the strongest last. A
  row's first dimensions are left out of it as far as their norm, times the greatest norm of the anchors there, stays
  below the least threshold: a row that reaches it must do so with the dimensions that are indexed.
* Partial scores are summed up over the index. A row goes as soon as its partial score and the norms of what is left
  (by Cauchy and Schwarz) are below the threshold for every anchor; pairs that remain are scored in full.
* Thresholds start high, from the scores with a bounded sample of rows, and are lowered for the windows that
  aren't filled: to a threshold that must fill them, or to the window's lower end. The sample sets thresholds only; the
  result is exact and doesn't depend on it.

Anchors meet rows in blocks: the anchors are the query set. A block's best few rows of a window are all that leaves
its task, so copies of a row or a large label don't pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portmesh.llm.common import stored, table

#: Rows of a block, and blocks whose anchors form one block of anchors.
BLOCK, ANCHOR_BLOCKS = 4096, 25
#: Rows of the sample that thresholds are taken from, about.
SAMPLE = 8192
#: Positives of an anchor, negatives of a positive, and the window of negatives in percent of the positive's score.
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 3, 50, 95

#: Dimensions that are added up before bounds are looked at, and anchors that are scored at once.
_GROUP, _AT_ONCE = 8, 512
#: Norm products below this are exact in double precision.
_EXACT = float(1 << 52)
_SLACK = 1 + 1e-9
_LONG = 1 << 63

# -- scores of one block --------------------------------------------------------------------------------------


def _scores(a: np.ndarray, y: np.ndarray, norms: float) -> np.ndarray:
    """Inner products of whole numbers, row by row, in the arithmetic that is exact for the product of
    their norms."""
    if norms < _EXACT:
        return np.einsum("ij,ij->i", a, y).astype(np.int64)
    if norms < _LONG / 2:
        return np.einsum("ij,ij->i", a.astype(np.int64), y.astype(np.int64))
    sums = (sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for r, s in zip(a, y, strict=True))
    return np.array([min(max(x, 1 - _LONG), _LONG - 1) for x in sums], np.int64)


def _pairs_above(a: np.ndarray, y: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may score ``need`` of the anchor or more, by index and bounds."""
    cuts = [*range(0, a.shape[1], _GROUP), a.shape[1]]
    norms_a = np.sqrt(np.concatenate([np.zeros((len(a), 1)), np.cumsum(a * a, 1)], 1)[:, cuts])
    norms_y = np.sqrt(np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, 1)], 1)[:, cuts])
    least = float(need.min())
    # groups that a row's index leaves out; rows that are left out as a whole cannot reach the threshold
    left_out = (norms_y * norms_a.max(0) * _SLACK < least).sum(1) - 1 if least > 0 else np.zeros(len(y), int)
    rows = np.argsort(left_out, kind="stable")
    rows = rows[left_out[rows] < len(cuts) - 1]
    y, norms_y, left_out = y[rows], norms_y[rows], left_out[rows]
    partial = np.zeros((len(a), len(rows)))
    goal = need[:, None] - 1e-6
    for g in reversed(range(len(cuts) - 1)):
        posted = int(np.searchsorted(left_out, g, "right"))  # rows that hold this group in the index
        if posted:
            partial[:, :posted] += a[:, cuts[g] : cuts[g + 1]] @ y[:posted, cuts[g] : cuts[g + 1]].T
        if g % 2 == 0 and len(rows):
            open_to = np.maximum(left_out, g)
            rest = norms_a[:, open_to] * norms_y[np.arange(len(rows)), open_to] * _SLACK
            possible = partial + rest >= goal
            alive = possible.any(0)
            if g and alive.mean() < 0.8:
                rows, y, norms_y, left_out = rows[alive], y[alive], norms_y[alive], left_out[alive]
                partial = partial[:, alive]
    if not len(rows):
        return np.zeros(0, int), np.zeros(0, int)
    ai, yi = np.nonzero(possible)  # the last round has looked at group 0
    return ai, rows[yi]


def scores_above(a: np.ndarray, y: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of all pairs with a score of the anchor's ``need`` or more. Whole numbers in
    double precision; scores beyond a long are its limits."""
    width = max(a.shape[1], y.shape[1])
    a, y = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, y))
    if not width or not len(a) or not len(y):
        ai, yi = np.nonzero(np.broadcast_to(need[:, None] <= 0, (len(a), len(y))))
        return ai, yi, np.zeros(len(ai), np.int64)
    with np.errstate(over="ignore"):
        norms = np.sqrt((a * a).sum(1)).max() * np.sqrt((y * y).sum(1)).max()
    order = np.argsort((y * y).sum(0), kind="stable") if norms < np.inf else np.arange(width)
    a, y = a[:, order], y[:, order]
    out = []
    for at in range(0, len(a), _AT_ONCE):
        part, goal = a[at : at + _AT_ONCE], need[at : at + _AT_ONCE]
        if norms < np.inf:
            ai, yi = _pairs_above(part, y, goal - (0 if norms < _EXACT else norms * 1e-9))
        else:
            ai, yi = (x.ravel() for x in np.indices((len(part), len(y))))
        for b in range(0, len(ai), 100_000):
            i, j = ai[b : b + 100_000], yi[b : b + 100_000]
            score = _scores(part[i], y[j], norms)
            keep = score >= goal[i]
            out.append((i[keep] + at, j[keep], score[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none, none), *out, strict=True))


def best_few(score: np.ndarray, ids: np.ndarray, want: int) -> np.ndarray:
    """Places of the first ``want`` by score (highest first), then id."""
    if len(score) > 4 * want + 64:  # those below the lowest that can count needn't be sorted
        least = np.partition(score, len(score) - want)[len(score) - want]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((ids[near], -score[near]))[:want]]
    return np.lexsort((ids, -score))[:want]


# -- blocks ----------------------------------------------------------------------------------------------------

_LAST = np.iinfo(np.int64).max  # a row without an id comes after all others


def _pack(rows: list[list[float]]) -> tuple[str, int, bytes]:
    width = max(map(len, rows))
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    kind = "<i2" if not m.size or abs(m).max() < 1 << 15 else "<f8"
    return kind, width, m.astype(kind).tobytes()


def _matrix(kind: str, width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, width).astype(float)


_BLOCK = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())),
     ("anchors", pa.list_(pa.bool_())), ("held", pa.list_(pa.int32())), ("kind", pa.string()), ("width", pa.int32()),
     ("data", pa.binary())]
)
_BLOCK_DDL = (
    "block long, n int, ids array<long>, labels array<int>, anchors array<boolean>, held array<int>, kind string, "
    "width int, data binary"
)


def _cut(size: int):
    """Rows of a sorted partition to blocks of ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, kept = TaskContext.get().partitionId(), 0, []

        def block(rows: list[dict]) -> pa.RecordBatch:
            kind, width, data = _pack([r["v"] for r in rows])
            labels = [r["label"] for r in rows]
            return pa.RecordBatch.from_pylist(
                [{"block": (part << 24) + k, "n": len(rows), "ids": [_LAST if r["vec_id"] is None else r["vec_id"] for r in rows],
                  "labels": labels, "anchors": [r["anchor"] for r in rows], "held": sorted(set(labels)), "kind": kind,
                  "width": width, "data": data}], schema=_BLOCK,
            )

        for batch in batches:
            kept += batch.to_pylist()
            while len(kept) >= size:
                yield block(kept[:size])
                kept, k = kept[size:], k + 1
        if kept:
            yield block(kept)

    return run


_ANCHOR = pa.schema(
    [("pos", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.float64()))]
)
_ANCHOR_DDL = "pos long, vec_id long, label int, v array<double>"


def _pick(size: int, share: float | None):
    """The anchors of blocks, or a pseudo-random share of all rows; ``pos`` numbers the rows of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                pos = b["block"] * size + np.arange(b["n"])
                if share is None:
                    at = np.flatnonzero(b["anchors"])
                else:
                    mixed = (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    at = np.flatnonzero((mixed >> np.uint64(11)).astype(float) < share * float(1 << 53))
                m = _matrix(b["kind"], b["width"], b["data"], b["n"])[at]
                yield pa.RecordBatch.from_pylist(
                    [{"pos": int(pos[i]), "vec_id": b["ids"][i], "label": b["labels"][i], "v": v.tolist()} for i, v in zip(at, m, strict=True)],
                    schema=_ANCHOR,
                )

    return run


# -- windows -----------------------------------------------------------------------------------------------------

_WINDOW = pa.schema(
    [("anchor", pa.int64()), ("w", pa.int32()), ("hi", pa.int64()), ("steps", pa.list_(pa.int64()))]
)
_WINDOW_DDL = "anchor long, w int, hi long, steps array<long>"


def _steps(score: np.ndarray, lo: int, hi: int, want: int, share: float) -> list[int]:
    """Thresholds to try for a window, in falling order: one that should fill it, one that must, its lower end.
    ``score`` are those of the sample, which is ``share`` of all rows."""
    inside = score[(score >= lo) & (score <= hi)]
    if len(inside) < want:
        return [lo]
    inside = np.sort(inside)[::-1]
    guess = min(want, max(1, int(np.ceil(8 * want * share))))
    return sorted({int(inside[guess - 1]), int(inside[want - 1]), lo}, reverse=True)


def _aim(sample: tuple[np.ndarray, np.ndarray, np.ndarray], share: float, same: bool, want: int, lowest: int, highest: int):
    """The windows of anchors: all scores with rows of the same label, or those around each positive's."""
    places, labels, m = sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, out = batch.slice(at, 256).to_pylist(), []
                a = np.array(_padded([r["v"] for r in rows]), float)
                width = max(a.shape[1], m.shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.pad(a, ((0, 0), (0, width - a.shape[1]))) @ np.pad(m, ((0, 0), (0, width - m.shape[1]))).T
                scores = np.nan_to_num(scores).clip(-float(1 << 62), float(1 << 62)).astype(np.int64)
                for r, score in zip(rows, scores, strict=True):
                    if same:
                        near = score[(labels == r["label"]) & (places != r["pos"])]
                        out.append({"anchor": r["pos"], "w": 0, "hi": _LONG - 1, "steps": _steps(near, -_LONG, _LONG - 1, want, share)})
                        continue
                    near = score[labels != r["label"]]
                    for x in r["positives"]:
                        lo, hi = -(-lowest * x["score"] // 100), highest * x["score"] // 100
                        if lo <= hi:
                            out.append({"anchor": r["pos"], "w": x["rank"], "hi": hi, "steps": _steps(near, lo, hi, want, share)})
                yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)

    return run


_HIT = pa.schema(
    [("anchor", pa.int64()), ("w", pa.int32()), ("pos", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)
_HIT_DDL = "anchor long, w int, pos long, vec_id long, score long"


def _search(size: int, same: bool, want: int):
    """The best rows of a block for each window of a block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                r = batch.slice(pair, 1).to_pylist()[0]
                asked = r["asked"]
                if not same and len(r["held"]) == 1 and {x["label"] for x in asked} == set(r["held"]):
                    continue
                y = _matrix(r["kind"], r["width"], r["data"], r["n"])
                a = np.array(_padded([x["v"] for x in asked]), float)
                ids, labels = np.array(r["ids"], np.int64), np.array(r["labels"], np.int64)
                pos = r["block"] * size + np.arange(r["n"])
                need = np.array([min(w["lo"] for w in x["windows"]) for x in asked], np.int64)
                ai, yi, score = scores_above(a, y, need)
                own = np.array([x["label"] for x in asked], np.int64)
                fits = labels[yi] == own[ai]
                if same:
                    fits &= pos[yi] != np.array([x["pos"] for x in asked], np.int64)[ai]
                else:
                    fits = ~fits
                ai, yi, score = ai[fits], yi[fits], score[fits]
                order = np.argsort(ai, kind="stable")
                ai, yi, score = ai[order], yi[order], score[order]
                begins = np.searchsorted(ai, np.arange(len(asked) + 1))
                out = []
                for i in np.unique(ai):
                    rows, found = yi[begins[i] : begins[i + 1]], score[begins[i] : begins[i + 1]]
                    for w in asked[i]["windows"]:
                        at = np.flatnonzero((found >= w["lo"]) & (found <= w["hi"]))
                        for j in at[best_few(found[at], ids[rows[at]], want)]:
                            out.append({"anchor": asked[i]["pos"], "w": w["w"], "pos": int(pos[rows[j]]),
                                        "vec_id": int(ids[rows[j]]), "score": int(found[j])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_HIT)

    return run


def _padded(rows: list[list[float]]) -> list[list[float]]:
    width = max(map(len, rows))
    return [r + [0.0] * (width - len(r)) for r in rows]


def _best(hits: DataFrame, want: int) -> DataFrame:
    """The first ``want`` hits of each window with their ``rank``."""
    first = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "pos")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= want)


def _fill(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, same: bool, want: int, size: int) -> DataFrame:
    """The best ``want`` rows of each window: thresholds are lowered until every window is filled or searched
    down to its end."""
    n_blocks = blocks.count()
    found, step = None, 0
    pending = windows
    while True:
        now = pending.where(F.size("steps") > step)
        upper = F.col("hi") if step == 0 else F.get("steps", F.lit(step - 1)) - 1
        now = now.select("anchor", F.struct("w", F.get("steps", F.lit(step)).alias("lo"), upper.alias("hi")).alias("x"))
        now = stored(now.groupBy("anchor").agg(F.collect_list("x").alias("windows")), "windows")
        if now.isEmpty():
            return found
        # anchors of neighbouring blocks, which mostly have one label, meet the rows together
        asked = anchors.join(now, F.col("pos") == F.col("anchor")).groupBy(
            F.expr(f"pos div {size * ANCHOR_BLOCKS}").alias("g")
        ).agg(F.collect_list(F.struct("pos", "label", "v", "windows")).alias("asked"))
        asked = stored(asked, "asked")
        # a short table of numbers, one row for some thousands of anchors
        numbers = asked.select("g").withColumn("i", F.row_number().over(Window.orderBy("g")) - 1)
        asked = asked.join(numbers, "g")
        n_asked = asked.count()
        if same:
            mine = asked.select("i", F.explode(F.array_distinct(F.transform("asked", lambda x: x["label"]))).alias("label"))
            theirs = blocks.select("block", F.explode("held").alias("label"))
            meet = theirs.join(mine, "label").select("block", "i").distinct()
            reach = blocks.drop("anchors").join(meet, "block")
        else:
            reach = blocks.drop("anchors").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        lanes = max(1, -(-n_blocks // 8))
        reach = reach.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
        asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        asked = asked.select("i", F.col("lane").cast("long").alias("lane"), "asked")
        hits = stored(reach.join(asked, ["i", "lane"]).mapInArrow(_search(size, same, want), _HIT_DDL), "hits")
        found = stored(_best(hits if found is None else found.drop("rank").unionByName(hits), want), "best")
        full = found.groupBy("anchor", "w").count().where(F.col("count") >= want)
        pending, step = windows.join(full, ["anchor", "w"], "left_anti"), step + 1


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    lowest: int = LOWEST, highest: int = HIGHEST, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: for each
    row for which ``anchor`` (a condition on ``vec_id``) is true and each of its first ``positives`` other rows of
    the same label, the first ``negatives`` rows of other labels whose score is ``lowest`` to ``highest`` percent of
    the positive's. ``vec_id``, ``embedding`` and ``label`` are read.

    A score is the inner product of the whole numbers floor(256 x); more comes first, then the smaller
    ``vec_id`` (null last). Rows with a null label, a null vector or a component that is null, infinite or not a
    number are left out. Of vectors of different length the missing components are 0. Rows given twice are rows
    of their own, so a copy of an anchor is a positive of it, and an anchor given twice has its rows twice. An
    empty table gives no rows. Scores beyond a long count as the limits of a long. ``block`` and ``sample``
    change the work, not the result.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(
        x, lambda e: F.when(F.abs(e) < float(1 << 44), F.floor(e * 256).cast("double")).otherwise(e * 256)
    )
    rows = vectors.select(
        F.col("`vec_id`").cast("long").alias("vec_id"),
        F.col("`label`").cast("int").alias("label"),
        F.col("`embedding`").cast("array<double>").alias("embedding"),
    )
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(
        "vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v")
    )
    # labels stand together, so that most blocks have one; the hash spreads a label over tasks
    spread = rows.withColumn("h", F.xxhash64("vec_id", "v"))
    spread = spread.repartitionByRange("label", "h").sortWithinPartitions("label", "h").drop("h")
    blocks = stored(spread.mapInArrow(_cut(block), _BLOCK_DDL), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = min(1.0, sample / max(total, 1))
    anchors = stored(blocks.mapInArrow(_pick(block, None), _ANCHOR_DDL), "anchors")
    picked = blocks.mapInArrow(_pick(block, share), _ANCHOR_DDL).collect()  # about ``sample`` rows at any size
    kept = (
        np.array([r.pos for r in picked], np.int64),
        np.array([r.label for r in picked], np.int64),
        np.array(_padded([list(r.v) for r in picked]), float) if picked else np.zeros((0, 0)),
    )
    tasks = -(-anchors.count() // 200) or 1
    windows = stored(anchors.repartition(tasks, "pos").mapInArrow(_aim(kept, share, True, positives, lowest, highest), _WINDOW_DDL), "aims")
    best = _fill(anchors, blocks, windows, True, positives, block)
    if best is None:  # no anchors
        best = windows.sparkSession.createDataFrame([], f"{_HIT_DDL}, rank int")
    listed = best.groupBy("anchor").agg(F.collect_list(F.struct("rank", "score")).alias("positives"))
    around = anchors.join(listed, F.col("pos") == F.col("anchor")).drop("anchor").repartition(tasks, "pos")
    aims = stored(around.mapInArrow(_aim(kept, share, False, negatives, lowest, highest), _WINDOW_DDL), "aims")
    hard = _fill(anchors, blocks, aims, False, negatives, block)
    if hard is None:
        hard = windows.sparkSession.createDataFrame([], f"{_HIT_DDL}, rank int")

    def shown(c: str) -> Column:
        return F.when(F.col(c) < _LAST, F.col(c))

    about = anchors.select(F.col("pos").alias("anchor"), shown("vec_id").alias("anchor_id"))
    of = best.select("anchor", F.col("rank").alias("w"), shown("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(of, ["anchor", "w"]).join(about, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), shown("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one first, as noise."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
with given as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v, row_number() over () as row from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from given where vec_id % 50 = 0),
scored as materialized (
  select a.row as anchor, a.vec_id as anchor_id, r.row, r.vec_id, a.label = r.label as same,
         list_dot_product(a.v, r.v)::bigint as score
  from anchors a join given r on a.row <> r.row),
positives as (
  select anchor, anchor_id, row, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id,
       row_number() over (partition by p.anchor, p.row order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, positive_score, s.score as negative_score
from positives p join scored s on s.anchor = p.anchor and not s.same
 and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify row_number() over (partition by p.anchor, p.row order by s.score desc, s.vec_id) <= 3"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": OP12_SQL}
