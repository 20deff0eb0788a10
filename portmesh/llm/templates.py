"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders; each keeps the
value that stood there as a slot. A text with names is taken in further forms: with names as plain words,
and with names that open a sentence as slots too. An item in which no window has enough plain words, in any
form, is taken as it stands, its numbers being words, and is found where it was copied with its values.
Windows of tokens are hashed and joined with those of the benchmark.
Hits of a document and an item that lie on one diagonal (document place minus item place) are one
alignment. An alignment that is long enough counts if its slots are consistent: equal item values stand
for equal document values, and different ones for different ones. So a question whose numbers and names
were swapped is found, and a chance meeting of two templates with jumbled values is not.

The window hashes of the benchmark go to every task as a filter if they are few enough to be broadcast;
otherwise all windows take part in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import columns_of, mix, stored, table, windows, word_hashes

#: Tokens of a window, and how many of them must be plain words (fewer in an item shorter than a window).
WIDTH, LEAST_PLAIN = 8, 5
#: An alignment counts with so many windows, or this part of the item's windows.
RUN, PART = 6, 0.5
#: Benchmarks of more distinct windows aren't broadcast.
BROADCAST_WINDOWS = 4_000_000

# Words for units, as they stand after a number.
UNITS = """
km kilometre kilometres kilometer kilometers m metre metres meter meters cm centimetre centimetres
centimeter centimeters mm mile miles yard yards foot feet ft inch inches kg kilogram kilograms g gram
grams mg lb lbs pound pounds ounce ounces oz ton tons tonne tonnes l litre litres liter liters ml gallon
gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years
dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh
""".split()

# Words that open a sentence with a capital and are no names.
COMMON = """
a about after all also although among an and another any are as assume at based because before below between
both but by calculate can choose compare complete compute consider could define describe determine did do does
due during each estimate evaluate every everyone everything explain express few find finally first following
for from given give had half has have he hence her here his how however i identify if in initially instead into
is it its last later least let like list many more most much my name neither next no none not note nothing now
of often on once one only or other otherwise our out over people per please prove read second select several
she should show similarly simplify since so solve some sometimes state still such suppose ten than that the
their them then there therefore these they third this those three through thus to today together two under
until up use using was we were what when where whether which while who whose why will with within without would
write yes yet you your
""".split()

PLAIN, NUMBER, NAME, UNIT = range(4)
#: Forms of a text: names as slots, names as words, names that open sentences as slots too, all as it stands.
SLOTS, WORDS, OPENERS, EXACT = range(4)
_SLOT = mix(np.array([0, 0xA11CE, 0xB0B, 0xCAFE], np.uint64))

_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True


def _view(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of letters, digits and non-ASCII bytes, and points and commas between digits;
    ASCII and Latin-1 capitals are hashed as small letters."""
    mask = _ASCII_WORD[raw]
    digit = _DIGIT[raw]
    if len(raw) > 2:
        mask[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    low[1:][_latin_capital(raw[:-1], raw[1:])] += 32
    return mask, low


def _latin_capital(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)


_UNITS = np.sort(np.concatenate([word_hashes(u.encode(), _view)[0] for u in UNITS]))
_COMMON = np.sort(np.concatenate([word_hashes(w.encode(), _view)[0] for w in COMMON]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def _typed(hashes: np.ndarray, kind: np.ndarray) -> Tokens:
    """Tokens, kinds and values of words of a ``kind``; names next to each other are one."""
    keep = np.ones(len(hashes), bool)
    keep[1:] = ~((kind[1:] == NAME) & (kind[:-1] == NAME))
    at = np.flatnonzero(keep)
    values, typed = np.add.reduceat(hashes, at), kind[at]
    return np.where(typed == PLAIN, hashes[at], _SLOT[typed]), typed, values


def canonical(text: str | None) -> dict[int, Tokens]:
    """The token hashes, kinds and slot values (hash of what stood there) of a text by form: ``SLOTS`` with
    names as slots; if there are any, ``WORDS`` with names as plain words (for copies in other capitals); if
    there are names that open a sentence or line, ``OPENERS`` with them as slots too; ``EXACT`` with every
    word, number and name as a plain word.

    A number starts with a digit; a unit is a listed word after a number; a name is a word of a capital
    and a small letter (or one beyond ASCII) that doesn't start a sentence or line, or in ``OPENERS`` also
    one that does and isn't among the ``COMMON`` words. Words in capitals, and single letters, are plain.
    """
    data = (text or "").encode("utf-8", "replace")
    hashes, starts, ends = word_hashes(data, _view)
    if not len(hashes):
        return {SLOTS: (hashes, np.zeros(0, np.int8), hashes)}
    raw = np.frombuffer(data, np.uint8)
    kind = np.zeros(len(hashes), np.int8)
    first = raw[starts]
    number = _DIGIT[first]
    kind[number] = NUMBER
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    ascii_capital, latin_capital = (first >= 65) & (first <= 90), _latin_capital(first, second)
    follows = starts + 1 + latin_capital
    after_first = raw[np.minimum(follows, len(raw) - 1)]
    small = (follows < ends) & (((after_first >= 97) & (after_first <= 122)) | (after_first >= 128))
    capital = (ascii_capital | latin_capital) & small
    stops = np.concatenate([[0], np.cumsum(_STOP[raw], dtype=np.int64)])
    opens = np.ones(len(hashes), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    kind[capital & ~opens] = NAME
    after = np.zeros(len(hashes), bool)
    after[1:] = number[:-1]
    kind[after & ~number & _among(hashes, _UNITS)] = UNIT
    out = {SLOTS: _typed(hashes, kind)}
    if (kind == NAME).any():
        out[WORDS] = _typed(hashes, np.where(kind == NAME, PLAIN, kind))
    opener = capital & opens & (kind == PLAIN)
    opener[opener] = ~_among(hashes[opener], _COMMON)
    if opener.any():
        out[OPENERS] = _typed(hashes, np.where(opener, NAME, kind).astype(np.int8))
    out[EXACT] = hashes, np.zeros(len(hashes), np.int8), hashes
    return out


def _windows(tokens: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the windows with enough plain words."""
    if len(tokens) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = windows(tokens, width, width)
    plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    enough = plain[width:] - plain[:-width] >= min(LEAST_PLAIN, width - 1)
    at = np.flatnonzero(enough)
    return at, hashes[at]


_ROWS = pa.schema(
    [("key", pa.int64()), ("t", pa.int64()), ("form", pa.int32()), ("width", pa.int32()), ("total", pa.int32()),
     ("at", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.int64()))]
)
_DDL = "key long, t long, form int, width int, total int, at long, h long, slots array<long>"


def _emit(widths: list[int] | None, known: np.ndarray | None, exact: list[int] = ()):
    """Rows of the windows: of each text's own width, and of the form ``EXACT`` only if the others have none
    (``widths`` None); or of all ``widths``, ``exact`` for the form ``EXACT``, and, unless ``known`` is None,
    only of hashes in it."""
    bits = None
    if known is not None:
        bits = np.zeros(1 << 22, bool)
        bits[known >> np.uint64(42)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _ROWS]
            keys, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, t, cell in zip(keys, ts, batch.column(2), strict=True):
                some = False
                for form, (tokens, kind, values) in canonical(cell.as_py()).items():
                    if widths is None:
                        each = [min(WIDTH, len(tokens))]
                        if len(tokens) < (1 if form == EXACT else 4) or form == EXACT and some:
                            each = []
                    else:
                        each = exact if form == EXACT else widths
                    for width in each:
                        at, hashes = _windows(tokens, kind, width)
                        total = len(at)
                        some |= total > 0
                        if bits is not None:
                            near = bits[hashes >> np.uint64(42)]
                            at, hashes = at[near], hashes[near]
                            sure = _among(hashes, known)
                            at, hashes = at[sure], hashes[sure]
                        for a, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            part = slice(a, a + width)
                            slots = values[part][kind[part] != PLAIN].view(np.int64).tolist()
                            for column, value in zip(out, (key, t, form, width, total, a, h, slots), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, _ROWS, strict=True)], schema=_ROWS
            )

    return run


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A stored row per window of each benchmark item: ``item_id``, ``form`` (see ``canonical``), ``width``,
    ``total`` windows of the item in that form, ``at``, ``h``, ``slots``."""
    items = benchmark.select(F.col("`item_id`").cast("long"), F.lit(0).cast("long"), F.col("`text`"))
    rows = items.mapInArrow(_emit(None, None), _DDL).withColumnRenamed("key", "item_id").drop("t").distinct()
    return stored(rows, "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row per document and benchmark item that it holds: ``doc_id``, ``t`` (hash of the text),
    ``item_id``, ``n_windows`` (of the longest consistent alignment), ``n_item_windows``, ``coverage``
    (their ratio) and ``n_slots`` (distinct values in its slots).

    ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of the benchmark are read. Null and
    empty texts hold nothing. Items of fewer tokens than a window match as a whole; those of fewer than
    four tokens, or with too few plain words for any window, match with the same numbers and names only.
    Rows given twice give one row. Empty tables give no rows.
    """
    items = item_windows(benchmark)
    kinds = items.select("width", F.col("form") == EXACT).distinct().collect()  # at most 2 * WIDTH rows
    widths, exact = (sorted(w for w, e in kinds if e == form) for form in (False, True))
    known = None
    if items.select("h").distinct().limit(most_broadcast + 1).count() <= most_broadcast:
        found = items.select("h").distinct().toPandas()["h"].to_numpy(np.int64)
        known = np.sort(found.view(np.uint64))
    text = columns_of(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text"
    )
    hits = text.mapInArrow(_emit(widths, known, exact), _DDL).select(
        F.col("key").alias("doc_id"), "t", F.col("form").alias("doc_form"), F.col("width").alias("w"), F.col("at").alias("doc_at"), "h",
        F.col("slots").alias("doc_slots"),
    )
    met = hits.join(items.withColumnRenamed("h", "item_h"), (F.col("h") == F.col("item_h")) & (F.col("w") == F.col("width")))
    pair = F.arrays_zip(F.col("slots").alias("i"), F.col("doc_slots").alias("d"))
    diagonal = (F.col("doc_at") - F.col("at")).alias("diagonal")
    lines = met.groupBy("doc_id", "t", "doc_form", "item_id", "form", "total", diagonal).agg(
        F.size(F.collect_set("at")).alias("n_windows"), F.col("total").alias("n_item_windows"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
    )
    # a diagonal has at most the item's windows
    n = F.size("pairs")
    consistent = (F.size(F.array_distinct("pairs.i")) == n) & (F.size(F.array_distinct("pairs.d")) == n)
    long = F.col("n_windows") >= F.least(F.lit(RUN), F.ceil(F.col("n_item_windows") * PART))
    # of alignments alike, one with sentence openers as words
    usual = (F.col("form") != OPENERS) & (F.col("doc_form") != OPENERS)
    best = F.max(F.struct("n_windows", "n_item_windows", usual.alias("usual"), n.alias("n_slots"))).alias("b")
    return (
        lines.where(consistent & long)
        .groupBy("doc_id", "t", "item_id")
        .agg(best)
        .select(
            "doc_id", "t", "item_id", "b.n_windows", "b.n_item_windows",
            (F.col("b.n_windows") / F.col("b.n_item_windows")).alias("coverage"), "b.n_slots",
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns."""
    held = stored(contaminated(docs, benchmark).select("doc_id", "t").distinct(), "held")
    rows = docs.select(
        F.struct("*").alias("row_"), F.col("`doc_id`").cast("long").alias("id_"), F.xxhash64("`text`").alias("t_")
    )
    same = F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("t_") == F.col("t"))
    return rows.join(held, same, "left_anti").select("row_.*")


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("t")


QUERIES = {"op7_templates": op7_templates}
SQL: dict[str, str] = {}
