"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A text is cut into paragraphs (a line and the line feeds behind it) and these into sentences, or pieces of 100
characters of longer ones; nothing is left out, so the root stands for the whole text. A leaf is the MD5 of a sentence, a branch the MD5 of its
children's digests. Sections are made of whole paragraphs: a heading (``#``) opens one, and a paragraph whose
digest begins with 0 to 3 closes one, so that boundaries follow content and an edit moves few of them.

The fingerprint holds the root, the sections' digests and 32 bits of each leaf::

    root:section=leaves,leaves;section=leaves

Equal roots are equal texts. Otherwise sections that both have are passed over as a whole, and the leaves of the
others are compared: their share is the likeness, and the first paragraph that differs locates the edit.

Documents are sorted by id over range partitions, each of which streams through one task that
holds two documents. The first and the last document of each partition are written with the results, and a
small join gives the last ones their successors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portmesh.llm.common import stored, table

_PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
_SENTENCE = re.compile(r"[^.!?]{1,100}(?:[.!?]+[ \n]*)?|[.!?]+[ \n]*")
#: A paragraph whose digest begins with one of these closes its section.
CLOSES = "0123"
_LEAF, _BRANCH = 8, 12
#: Sentences whose digests are remembered; only speed depends on it.
_KEPT = 20_000


class _Digests(dict):
    def __missing__(self, sentence: str) -> str:
        if len(self) > _KEPT:
            self.clear()
        found = self[sentence] = _md5(sentence)
        return found


def _md5(text: str) -> str:
    return md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint(text: str | None, digests: dict | None = None) -> str:
    """The fingerprint of a text; null is empty."""
    digests = _Digests() if digests is None else digests
    root, shown = [], []
    branch: list[str] = []
    leaves: list[str] = []

    def close() -> None:
        if branch:
            digest = _md5("".join(branch))
            root.append(digest)
            shown.append(f"{digest[:_BRANCH]}={','.join(leaves)}")
            branch.clear()
            leaves.clear()

    for paragraph in _PARAGRAPH.findall(text or ""):
        if paragraph[0] == "#":
            close()
        parts = [digests[s] for s in _SENTENCE.findall(paragraph)]
        digest = _md5("".join(parts))
        branch.append(digest)
        leaves.append("".join([p[:_LEAF] for p in parts]))
        if digest[0] in CLOSES:
            close()
    close()
    return f"{_md5(''.join(root))}:{';'.join(shown)}"


def sections(print_: str) -> list[tuple[str, list[str]]]:
    """The sections of a fingerprint: the digest and the leaves of each paragraph."""
    body = print_.partition(":")[2]
    return [(s[:_BRANCH], s[_BRANCH + 1 :].split(",")) for s in body.split(";")] if body else []


def _root(print_: str) -> str:
    return print_.partition(":")[0]


def likeness(a: str, b: str) -> float:
    """Twice the shared leaves of two fingerprints over all of their leaves; 1 if their roots are equal."""
    if _root(a) == _root(b):
        return 1.0
    x, y = sections(a), sections(b)
    both = Counter(s for s, _ in x) & Counter(s for s, _ in y)
    shared, total, rest = 0, 0, []
    for side in (x, y):
        left, mine = both.copy(), Counter()
        for digest, paragraphs in side:
            n = sum(map(len, paragraphs)) // _LEAF
            total += n
            if left[digest]:  # a branch that both have
                left[digest] -= 1
                shared += n
            else:
                mine.update(p[i : i + _LEAF] for p in paragraphs for i in range(0, len(p), _LEAF))
        rest.append(mine)
    return (shared + 2 * (rest[0] & rest[1]).total()) / total


def first_edit(a: str, b: str) -> int | None:
    """Number of the first paragraph in which two texts differ, from 0; None if their roots are equal."""
    if _root(a) == _root(b):
        return None
    x, y = sections(a), sections(b)
    at = 0
    k = 0
    while k < len(x) and k < len(y) and x[k] == y[k]:
        at += len(x[k][1])
        k += 1
    p, q = ([leaves for _, part in side[k:] for leaves in part] for side in (x, y))
    for u, v in zip(p, q, strict=False):
        if u != v:
            break
        at += 1
    return at


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Section and paragraph (from 0) of ``b`` for each paragraph that is not in ``a``, by branches that differ."""
    known = Counter(s for s, _ in sections(a))
    paragraphs = Counter(p for _, part in sections(a) for p in part)
    out = []
    for i, (digest, part) in enumerate(sections(b)):
        if known[digest]:
            known[digest] -= 1
            paragraphs.subtract(part)
            continue
        for j, p in enumerate(part):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                out.append((i, j))
    return out


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_edit", pa.int64()),
]
_RESULT = pa.schema(_FIELDS)
_RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, first_edit long"
)
#: With the texts at the two ends of a partition: ``side`` is ``first`` or ``last``, null for a result.
_ROW = pa.schema([*_FIELDS, ("part", pa.int32()), ("side", pa.string()), ("text", pa.string())])
_ROW_DDL = _RESULT_DDL + ", part int, side string, text string"


def edited(text: str, following: str) -> str:
    """``text`` with the last half of its code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id: int | None, text: str, own: str, following: str, following_print: str, digests: dict) -> dict:
    changed = edited(text, following)
    new = own if changed == text else fingerprint(changed, digests)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own, "edited_fingerprint": new, "near_edited": likeness(own, new),
        "near_next": likeness(own, following_print), "first_edit": first_edit(own, new),
    }


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, digests, last = TaskContext.get().partitionId(), _Digests(), None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = r["text"]
            if last is None:
                out.append({"part": part, "side": "first", "text": text})
            own = last[2] if last and last[1] == text else fingerprint(text, digests)
            if last:
                out.append(_compared(*last, text, own, digests))
            last = (r["doc_id"], text, own)
        yield pa.RecordBatch.from_pylist(out, schema=_ROW)
    if last:
        yield pa.RecordBatch.from_pylist([{"part": part, "side": "last", "doc_id": last[0], "text": last[1]}], schema=_ROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, digests = [], _Digests()
        for r in batch.to_pylist():
            text, following = r["text"], r["following"]
            out.append(_compared(r["doc_id"], text, fingerprint(text, digests), following, fingerprint(following, digests), digests))
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (``doc_id`` and ``text`` are read): ``n_chars``; ``fingerprint``; of the
    edited text, whose last half is replaced by the beginning of the next document's, ``edited_sha256`` and
    ``edited_fingerprint``; ``near_edited`` and ``near_next``, how like its fingerprint is to the edited text's
    and to the next document's; ``first_edit``, the paragraph (from 0) of the edited text in which the first
    change lies (null without one).

    The next document is the next by ``doc_id`` (nulls first; rows of one id by the MD5 of their text); after
    the last comes the first, which is the same one in a table of one row. Null texts are empty, and an empty text is like an
    empty one only. Rows given twice give two rows. An empty table gives none.
    """
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tie", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    found = stored(rows.mapInArrow(_sorted_part, _ROW_DDL), "prints", compression="zstd")  # digits of digests
    firsts = found.where("side = 'first'").select(F.col("part").alias("p"), F.col("text").alias("following"))
    # two rows a partition from here on
    numbers = Window.orderBy("part")
    order = found.where("side = 'last'").select("part").withColumn("p", F.lead("part").over(numbers))
    order = order.withColumn("p", F.coalesce("p", F.min("part").over(Window.partitionBy())))
    ends = found.where("side = 'last'").join(order, "part").join(firsts, "p").select("doc_id", "text", "following")
    return found.where("side is null").select(*_RESULT.names).unionByName(ends.mapInArrow(_ends, _RESULT_DDL))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over o as i, doc_id, coalesce(text, '') as t,
         coalesce(lead(coalesce(text, '')) over o, first_value(coalesce(text, '')) over o) as following,
         coalesce(lead(rn) over o, 1) as next_i
  from (select *, row_number() over (order by doc_id nulls first, md5(coalesce(text, ''))) as rn from documents)
  window o as (order by rn)),
texts as (
  select i, 0 as kind, t from d
  union all
  select i, 1, left(t, length(t) - length(t) // 2) || left(following, length(t) // 2) from d),
paragraphs as (
  select i, kind, generate_subscripts(ps, 1) as k, unnest(ps) as p_ from (
    select i, kind, regexp_extract_all(t, '[^\n]*\n+|[^\n]+') as ps from texts)),
leaves as (
  select i, kind, k, left(p_, 1) = '#' as opens,
         list_transform(regexp_extract_all(p_, '[^.!?]{1,100}(?:[.!?]+[ \n]*)?|[.!?]+[ \n]*'), lambda x: md5(x)) as l from paragraphs),
digests as (
  select i, kind, k, l, opens, md5(list_aggregate(l, 'string_agg', '')) as digest,
         list_aggregate(list_transform(l, lambda x: x[1:8]), 'string_agg', '') as codes from leaves),
cuts as (
  select *, coalesce(lag(digest[1] in ('0', '1', '2', '3')) over w, true) or opens as fresh from digests
  window w as (partition by i, kind order by k)),
numbered as (select *, sum(fresh::int) over (partition by i, kind order by k) as section from cuts),
branches as (
  select i, kind, section, md5(string_agg(digest, '' order by k)) as digest, string_agg(codes, ',' order by k) as codes
  from numbered group by i, kind, section),
prints as (
  select i, kind, coalesce(md5(string_agg(digest, '' order by section)), md5('')) as root,
         coalesce(string_agg(digest[1:12] || '=' || codes, ';' order by section), '') as body
  from texts left join branches using (i, kind) group by i, kind),
codes as (
  select i, kind, x, count(*) as n from (
    select i, kind, unnest(list_transform(l, lambda x: x[1:8])) as x from leaves) group by i, kind, x),
totals as (select i, kind, sum(n) as n from codes group by i, kind),
pairs as (
  select i, 'edited' as what, i as j, 1 as other from d union all select i, 'next', next_i, 0 from d),
shared as (
  select p.i, p.what, sum(least(a.n, b.n)) as n from pairs p
  join codes a on a.i = p.i and a.kind = 0 join codes b on b.i = p.j and b.kind = p.other and b.x = a.x group by p.i, p.what),
likeness as (
  select p.i, p.what, case when a.root = b.root then 1.0
    else 2.0 * coalesce(s.n, 0) / (coalesce(m.n, 0) + coalesce(n.n, 0)) end::double as likeness
  from pairs p join prints a on a.i = p.i and a.kind = 0 join prints b on b.i = p.j and b.kind = p.other
  left join shared s on s.i = p.i and s.what = p.what
  left join totals m on m.i = p.i and m.kind = 0 left join totals n on n.i = p.j and n.kind = p.other),
paired as (
  select coalesce(a.i, b.i) as i, coalesce(a.k, b.k) as k, a.digest is distinct from b.digest as differs
  from (select * from digests where kind = 0) a full join (select * from digests where kind = 1) b on a.i = b.i and a.k = b.k),
places as (select i, min(k) - 1 as first_edit from paired where differs group by i)
select d.doc_id, length(d.t) as n_chars, sha256(e.t) as edited_sha256, f.root || ':' || f.body as fingerprint,
       g.root || ':' || g.body as edited_fingerprint, x.likeness as near_edited, y.likeness as near_next, z.first_edit
from d join texts e on e.i = d.i and e.kind = 1 join prints f on f.i = d.i and f.kind = 0
join prints g on g.i = d.i and g.kind = 1 join likeness x on x.i = d.i and x.what = 'edited'
join likeness y on y.i = d.i and y.what = 'next' left join places z on z.i = d.i"""

QUERIES = {"op13_merkle_fingerprints": op13_merkle_fingerprints}
SQL = {"op13_merkle_fingerprints": OP13_SQL}
