"""Token-id output: documents encoded in order into wavelet-matrix shards, and read back.

The order comes from a range partitioning; a task encodes its range document by document and closes a
shard file when it holds enough tokens, so memory is bounded by a shard and the longest document. A shard
is written under a temporary name and renamed, and its name and content follow from its range, so a
repeated task writes the same file again.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portmesh.llm.common import stored, table
from portmesh.llm.wavelet import WaveletMatrix, write
from portmesh.session import scratch_folder

#: Id put after each document.
END = 2
#: Tokens after which a shard is closed, and characters of text for one range of documents; with more than
#: ``MOST_RANGES`` of them they get larger instead, and hold more shards.
SHARD_TOKENS = 8_000_000
RANGE_CHARS, MOST_RANGES = 20_000_000, 50_000
#: Pieces whose ids a worker keeps; only speed depends on it.
KEPT_PIECES = 700_000

# The steps of a tokenizer file whose texts can be encoded piece by piece.
BY_PIECE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Texts of these characters only: composition changes nothing, small letters follow from each character
#: alone, and letters, digits and white space are the same for every library.
_SIMPLE = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa0-\u02ff]*")


def _simple_cut() -> re.Pattern:
    """The file's cuts for simple characters and their small letters (some lie beyond the range), with
    letters first as no other cut starts with one."""
    of = {"L": "", "N": ""}
    simple = [chr(n) for n in range(0x300)]
    for c in dict.fromkeys([*simple, *"".join(simple).lower()]):
        kind = unicodedata.category(c)[0]
        if kind in of:
            of[kind] += re.escape(c)
    letter, digit = of["L"], of["N"]
    return re.compile(rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{digit}]|[^\s{letter}{digit}]+")


_CUT = _simple_cut()


def _byte_symbols() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes texts with a ``tokenizers`` file; remembers the ids of the pieces between its cuts.

    Under a file whose steps are ``BY_PIECE``, a text is cut into pieces that the file's model encodes one
    by one, so only pieces that are not remembered go to the model. A text with other than simple
    characters, or that might hold a special token, and every text under another file, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        steps = json.loads(self.whole.to_str())
        self.model = self.whole.model if all(steps[k] == v for k, v in BY_PIECE.items()) else None
        self.kept = _Pieces(self.model)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.model is None or "<|" in text or not _SIMPLE.fullmatch(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, _CUT.findall(text.lower())))


class _Pieces(dict):
    """The ids of pieces; those that are missing are worked out."""

    def __init__(self, model):
        super().__init__()
        self.model, self.symbols = model, _byte_symbols()

    def __missing__(self, piece: str) -> bytes:
        spelt = "".join([self.symbols[b] for b in piece.encode()])
        found = self[piece] = array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()
        return found


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given as a URI or a plain path."""
    folder = re.sub(r"^file:/+", "file:///", folder)
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def _put(fs: pafs.FileSystem, name: str, attempt: str, data: bytes) -> None:
    """A file that is there whole or not at all; another attempt's file has the same content."""
    with fs.open_output_stream(f"{name}.{attempt}") as out:
        out.write(data)
    try:
        fs.move(f"{name}.{attempt}", name)
    except OSError:  # some file systems don't replace a file
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(f"{name}.{attempt}")


_FILES = "part long, seq long, file string, docs long, tokens long"


def _writer(folder: str, tokenizer: str, end: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        task = TaskContext.get()
        part, encode = task.partitionId(), encoder(tokenizer)
        last = np.array([end], "<u4").tobytes()
        seq, docs, parts, counts, size = 0, [], [], [], 0
        rows: list[tuple] = []

        def close():
            nonlocal seq, docs, parts, counts, size
            name = f"{part:09d}-{seq:06d}.wvm"
            ids = np.frombuffer(b"".join(parts), "<u4")
            nulls = np.array([d is None for d in docs], bool)
            data = write(ids, np.array([d or 0 for d in docs], np.int64), nulls, np.array(counts, np.int64))
            _put(fs, f"{root}/{name}", f"{task.taskAttemptId()}", data)
            rows.append((part, seq, name, len(docs), len(ids)))
            seq, docs, parts, counts, size = seq + 1, [], [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.ids(text.as_py() or "") + last
                docs.append(doc_id), parts.append(ids), counts.append(len(ids) // 4)
                size += counts[-1]
                if size >= shard_tokens:
                    close()
        if docs:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "seq", "file", "docs", "tokens"],
        )

    return run


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, order: list[Column] | None = None, end: int = END,
    shard_tokens: int = SHARD_TOKENS, range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """Encodes ``doc_id`` and ``text`` of ``docs`` in ascending order (of ``doc_id``, nulls first, then the
    text's hash, unless ``order`` is given) into shards under ``folder``.

    Returns the stored list of files: ``part``, ``seq`` (their order), ``file``, ``docs``, ``tokens`` and
    ``start`` (tokens before). A null text is empty; an empty text has the end id alone. An empty table
    gives an empty list.
    """
    order = order or [F.col("`doc_id`").cast("long"), F.xxhash64("`text`")]
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"),
        *(c.alias(f"o{i}") for i, c in enumerate(order)),
    )
    keys = [f"o{i}" for i in range(len(order))]
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    ranged = rows.repartitionByRange(min(MOST_RANGES, chars // range_chars + 1), *keys).sortWithinPartitions(*keys)
    files = stored(
        ranged.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end, shard_tokens), _FILES), "files"
    )
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = WaveletMatrix(f.read())
                raw = shard.tokens().astype("<u4").tobytes()
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs, pa.int64(), mask=shard.nulls), pa.array(starts + start, pa.int64()),
                     pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """From the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (unsigned crc32 of the ids as
    little-endian 32-bit integers) of each document, a task per few files."""
    listed = stored(files.select("file", "start"), "listed")
    n = listed.count()
    spread = listed.repartition(max(1, min(n, 10_000)))
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, order: list[Column] | None = None) -> DataFrame:
    """Writes shards into a new folder beside the checkpoints and returns what is read back from them."""
    folder = scratch_folder(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, tokenizer, folder, order), folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op10_wavelet_tokens": op10_wavelet_tokens}
SQL: dict[str, str] = {}
