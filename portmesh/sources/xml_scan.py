"""Elements of XML files of any size, read in parallel.

A file is split anywhere. Its text is read as one row per tag, with the text behind it (the line separator is
``<``), and each task puts the tags of its split together to elements, whole Arrow batches at a time. What a task cannot
know is settled by a table with one row per split: the element that a split's end cuts goes on with the head of the next
split, and the last opening tag of the surrounding element (such as ``GraphSnapshot``) is carried on to the splits that
don't hold one. A row is a pack of small elements in a row, however large the element around them is: an XML
parser costs more to set up than an element costs to parse, so a pack is parsed at once. Files of more than one split are
taken apart once for the elements and once for that table.

A comment or CDATA section may hold anything, but if it contains one of the tags below and a split's end lies inside it,
those tags count in the second split.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The elements that readers look for; none lies inside another one of the same reader.
ELEMENTS = (
    "GraphType GraphTypeReference GraphInstance DeviceInstances EdgeInstances DevI EdgeI "
    "GraphLog InitEvent SendEvent RecvEvent GraphSnapshot DevS EdgeS"
).split()

# A pack is closed by either; a larger element is a pack of its own.
PACK_ROWS, PACK_BYTES = 100, 1 << 16

_EMPTY = r"""^[^\s/>]+(?:\s+[^\s=]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/>"""
_OTHER, _OPEN, _WHOLE, _CLOSE, _AROUND = range(5)
_WHOLE_FILES = r"\.(gz|deflate)$"


def _one_of(names) -> str:
    return f"(?:{'|'.join(names)})"


_ATTRIBUTE = re.compile(r"""\s([^\s=]+)\s*=\s*("[^"]*"|'[^']*')""")


def attributes(tag: str, names: tuple[str, ...]) -> list[str | None]:
    """The named attributes of an opening tag; None for those it hasn't."""
    found = {k: html.unescape(v[1:-1]) for k, v in _ATTRIBUTE.findall(tag)}
    return [found.get(n) for n in names]


def _joined(tags: pa.Array) -> str:
    return "<".join(tags.to_pylist())


class _Split:
    """The elements of one split, fed batch by batch."""

    def __init__(self, tags: tuple[str, ...], around: str | None, names: tuple[str, ...], build: bool = True):
        self.build, self.names = build, names
        self.patterns = {
            _OPEN: rf"^{_one_of(tags)}(?:[\s/>]|$)",
            _CLOSE: rf"^/{_one_of(tags)}\s*>",
        } | ({_AROUND: rf"^{around}(?:[\s/>]|$)"} if around else {})
        self.known = rf"^/?{_one_of({*ELEMENTS, *tags})}(?:[\s/>]|$)"
        self.head: list[str] = []
        self.blank = True  # no known tag so far
        self.open: list[str] | None = None
        self.open_around = self.around = None
        self.skipping: str | None = None

    def _unread(self, tags: pa.Array) -> np.ndarray | None:
        """Which tags lie in comments or CDATA sections."""
        marks = pc.or_(pc.starts_with(tags, "!--"), pc.starts_with(tags, "![CDATA["))
        at = np.flatnonzero(marks.to_numpy(zero_copy_only=False))
        if not len(at) and not self.skipping:
            return None
        out, i = np.zeros(len(tags), bool), 0
        while True:
            if not self.skipping:
                later = at[at >= i]
                if not len(later):
                    return out
                i = int(later[0])
                self.skipping = "-->" if tags[i].as_py().startswith("!--") else "]]>"
            ends = pc.match_substring(tags.slice(i), self.skipping).to_numpy(zero_copy_only=False)
            found = np.flatnonzero(ends)
            stop = i + int(found[0]) + 1 if len(found) else len(tags)
            out[i:stop] = True
            if not len(found):
                return out
            self.skipping, i = None, stop

    def feed(self, tags: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Elements that end in these tags, one begun before first; and what is around each, as places in a list."""
        live = pc.match_substring_regex(tags, self.known).to_numpy(zero_copy_only=False)
        unread = self._unread(tags)
        if unread is not None:
            live = live & ~unread
        at = np.flatnonzero(live)
        if not len(at):
            if self.blank:
                self.head.append(_joined(tags))
            elif self.open is not None:
                self.open.append(_joined(tags))
            return pa.array([], pa.string()), np.arange(0), _lists([])
        some = tags.take(pa.array(at))
        kind = np.full(len(at), _OTHER)
        for k, pattern in self.patterns.items():
            kind[pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)] = k
        # few tags end like an empty element, and only those need a closer look
        maybe = np.flatnonzero((kind == _OPEN) & pc.ends_with(pc.utf8_rtrim_whitespace(some), "/>").to_numpy(zero_copy_only=False))
        if len(maybe):
            empty = pc.match_substring_regex(some.take(pa.array(maybe)), _EMPTY).to_numpy(zero_copy_only=False)
            kind[maybe[empty]] = _WHOLE
        ready, ready_around = [], []
        before = int(at[0]) + int(kind[0] == _CLOSE)
        if self.blank:
            if before:
                self.head.append(_joined(tags.slice(0, before)))
            self.blank = False
        elif self.open is not None:
            if before:
                self.open.append(_joined(tags.slice(0, before)))
            ready.append("<".join(self.open))
            ready_around.append(self.open_around)
            self.open = None
        # an element lasts to its closing tag, or to the next known tag if that comes first
        begins = np.flatnonzero((kind == _OPEN) | (kind == _WHOLE))
        follows = np.minimum(begins + 1, len(at) - 1)
        stops = np.where(kind[begins] == _WHOLE, at[begins] + 1, at[follows] + (kind[follows] == _CLOSE))
        lines = np.flatnonzero(kind == _AROUND)
        known = [self.around, *(attributes(x, self.names) for x in some.take(pa.array(lines)).to_pylist())]
        held = np.searchsorted(lines, begins)
        if len(begins) and begins[-1] == len(at) - 1 and kind[begins[-1]] == _OPEN:
            self.open = [f"<{_joined(tags.slice(int(at[-1])))}"]
            self.open_around = known[held[-1]]
            begins, stops, held = begins[:-1], stops[:-1], held[:-1]
        self.around = known[-1]
        if not len(begins) or not self.build:
            return pa.array(ready, pa.string()), np.arange(len(ready)), _lists(ready_around)
        starts = at[begins]
        sizes = stops - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tags.take(pa.array(taken)))
        texts = pc.binary_join_element_wise("", pc.binary_join(lists, "<"), "<")
        around = _lists([*ready_around, *known])
        places = np.concatenate([np.arange(len(ready)), len(ready) + held])
        return pa.concat_arrays([pa.array(ready, pa.string()), texts]), places, around


def _lists(values: list) -> pa.Array:
    return pa.array(values, pa.list_(pa.string()))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """The tags of a task, cut where a split ends."""
    for batch in batches:
        file, split = (batch.column(k).to_numpy() for k in (1, 2))
        cuts = np.flatnonzero((np.diff(split) != 0) | (np.diff(file) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield (int(file[a]), int(split[a])), batch.column(0).slice(a, b - a)


def _packs(texts: pa.Array, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Neighbours with the same element around them as lists, and where each list begins."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.arange(n) % PACK_ROWS == 0
    cut |= np.diff(np.cumsum(size) // PACK_BYTES, prepend=-1) != 0
    cut[1:] |= (size[:-1] >= PACK_BYTES) | (np.diff(places) != 0)
    starts = np.flatnonzero(cut)
    return pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), texts), starts


_INSIDE = pa.schema(
    [("file", pa.int64()), ("split", pa.int64()), ("texts", pa.list_(pa.string())), ("around", pa.list_(pa.string()))]
)
_ENDS = pa.schema(
    [("file", pa.int64()), ("split", pa.int64()), ("head", pa.string()), ("blank", pa.bool_()), ("open", pa.string()),
     ("open_around", pa.list_(pa.string())), ("around", pa.list_(pa.string()))]
)


def _inside(tags: tuple[str, ...], around: str | None, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = split = None
        for now, values in _runs(batches):
            if now != key:
                key, split = now, _Split(tags, around, names)
            found, places, held = split.feed(values)
            if len(found):
                packs, starts = _packs(found, places)
                columns = [pa.array(np.full(len(starts), k, np.int64)) for k in key]
                around_each = held.take(pa.array(places[starts]))
                yield pa.RecordBatch.from_arrays([*columns, packs, around_each], schema=_INSIDE)

    return run


def _ends(tags: tuple[str, ...], around: str | None, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = split = None

        def done() -> pa.RecordBatch:
            row = {
                "file": key[0], "split": key[1], "head": "<".join(split.head) if split.head else None, "blank": split.blank,
                "open": None if split.open is None else "<".join(split.open), "open_around": split.open_around, "around": split.around,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ENDS)

        for now, values in _runs(batches):
            if now != key:
                if key:
                    yield done()
                key, split = now, _Split(tags, around, names, build=False)
            split.feed(values)
        if key:
            yield done()

    return run


def scan_elements(
    spark: SparkSession, path: str, tags: str, around: str | None = None, attributes: str = ""
) -> DataFrame:
    """``texts`` of the elements with one of the ``tags`` (space separated), some neighbours to a row, and ``around``:
    the values of the named ``attributes`` of the last opening tag ``around`` before them in their file, null if there is
    none.

    An element that one of ``ELEMENTS`` opens or closes before its own end lasts only to there: so the text of a
    ``GraphInstance`` is its head. The order of rows is not that of the file.
    """
    how = (tuple(tags.split()), around, tuple(attributes.split()))
    lines = (
        spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").text(path)
        .select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("part"))
    )
    columns = ["value", "file", "split"]
    inside = lines.select(*columns).mapInArrow(_inside(*how), "file long, split long, texts array<string>, around array<string>")
    # only files that are split have anything to settle; those that can't be are not read for it
    ends = lines.where("part").where(~F.col("_metadata.file_name").rlike(_WHOLE_FILES)).select(*columns).mapInArrow(
        _ends(*how),
        "file long, split long, head string, blank boolean, open string, open_around array<string>, around array<string>",
    )
    # one row per split from here on
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "*",
        F.last("around", True).over(before).alias("carried"),
        F.last(F.when(~F.col("blank"), F.col("split")), True).over(before).alias("cut"),
    )
    # the head of a split belongs to the cut split before it
    pieces = ends.select("file", F.explode(F.array(
        F.struct("split", "open", "open_around", "carried", F.lit(None).cast("struct<split:bigint,head:string>").alias("head")),
        F.struct(F.col("cut").alias("split"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("open", "string"), ("open_around", "array<string>"), ("carried", "array<string>"))),
            F.when(F.col("head").isNotNull(), F.struct("split", "head")).alias("head")),
    )).alias("p")).select("file", "p.*")
    joined = pieces.groupBy("file", "split").agg(
        F.max("open").alias("open"), F.max("open_around").alias("open_around"), F.max("carried").alias("carried"),
        F.array_join(F.transform(F.sort_array(F.collect_list("head")), lambda x: x["head"]), "<").alias("rest"),
        F.count("head").alias("heads"),
    )
    across = joined.where("open is not null").select(
        F.array(F.concat_ws("<", "open", F.when(F.col("heads") > 0, F.col("rest")))).alias("texts"),
        F.coalesce("open_around", "carried").alias("around"),
    )
    if around:
        carried = ends.select("file", "split", "carried")
        inside = inside.join(carried, ["file", "split"], "left").withColumn("around", F.coalesce("around", "carried"))
    return inside.select("texts", "around").unionByName(across)


def parsed(elements: DataFrame, tags: str, schema: T.StructType, head: str | None = None) -> DataFrame:
    """The members of ``schema`` of each element with one of the ``tags``, its ``tag``, and ``around``. ``head`` names an
    element that may be without its end.

    A pack is parsed as one document; if that fails, its elements are parsed one by one.
    """
    trimmed = lambda text: F.rtrim(text, F.lit(" \t\r\n"))
    if head:

        def ended(text: Column) -> Column:
            whole = trimmed(text).rlike(rf"</{head}\s*>$|^<[^<]*/>$")
            return F.when(whole, text).otherwise(F.concat(trimmed(text), F.lit(f"</{head}>")))

        elements = elements.withColumn("texts", F.transform("texts", ended))
    options = {"valueTag": "_text", "ignoreNamespace": "true"}
    names = tags.split()
    together = T.StructType(
        [*(T.StructField(n, T.ArrayType(schema)) for n in names), T.StructField("_unread", T.StringType())]
    )
    document = F.concat(F.lit("<_>"), F.array_join("texts", "\n"), F.lit("</_>"))
    packs = elements.withColumn(
        "_all", F.from_xml(document, together, {**options, "columnNameOfCorruptRecord": "_unread"})
    )

    def of(tag: str) -> Column:
        found = F.coalesce(F.col(f"_all.{tag}"), F.array().cast(T.ArrayType(schema)))
        return F.transform(found, lambda e: F.struct(F.lit(tag).alias("tag"), e.alias("_e")))

    def single(text: Column) -> Column:
        tag = F.regexp_extract(text, r"^<([^\s/>]+)", 1)
        return F.struct(tag.alias("tag"), F.from_xml(trimmed(text), schema, options).alias("_e"))

    whole = F.concat(*(of(n) for n in names))
    good = F.col("_all").isNotNull() & F.col("_all._unread").isNull() & (F.size(whole) == F.size("texts"))
    rows = packs.select("around", F.inline(F.when(good, whole).otherwise(F.transform("texts", single))))
    return rows.select("_e.*", "tag", "around")
