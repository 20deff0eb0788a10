"""Conversation structure repair by depth-first branch and bound.

A conversation should be an optional system message and then pairs of a user's and an assistant's. Its rows
are kept, given another role, deleted, or empty messages are inserted, at the least cost; of equally cheap
repairs the one whose edits, written as letters, come first in ASCII.

The search goes over nodes (row, state), the state being the role of the last message put out. It keeps an
explicit stack, an incumbent (cost, audit), suffix lower bounds from a relaxed form of the rules (in which
a system message alone is complete), and a table of the best (cost, audit) with which each node was reached:
a worse prefix is dropped, as any way on from it is open to the better one too. It ends when nothing
on the stack can beat the incumbent, which is then proved best.

Conversations of any length: rows are numbered by a range sort, and each run of ``SEGMENT`` row numbers is
searched on its own, for each state before and after it. What the runs of a conversation found is
put together from its end, which is exact as the edits of a run end with a row's edit, so that no audit
of a run begins another one of the same cost. Texts are moved once, to be hashed in their order: SHA-256 is a
chain, so the repaired text of one conversation streams through one task, row by row; that task holds a few
bytes a row, for the audit that it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import stored, table

#: Row numbers that are searched together.
SEGMENT = 512

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: What completes a repair after each state: 0 nothing put out, 1 system, 2 user, 3 assistant.
TAILS = {0: "", 1: "II", 2: "I", 3: ""}
_EXPECTED = ("u", "u", "a", "u")
_AFTER = (2, 2, 3, 2)
#: The relaxed rules take a system message for a complete pair.
_RELAXED = (0, 3, 2, 3)
_ROLES = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60

_BLANK = " \t\n\x0b\x0c\r"


def _least_costs(rows: list[str], ends: dict[int, str]) -> list[dict[int, int]]:
    """For each row and relaxed state, a lower bound on the cost of what follows."""
    last = dict.fromkeys((0, 2, 3), _NEVER)
    for state, tail in ends.items():
        last[_RELAXED[state]] = min(last[_RELAXED[state]], INSERT * len(tail))
    out = [last]
    for role, kind in reversed(rows):
        after, here = out[-1], {}
        for state in (0, 2, 3):
            best = DELETE + after[state]
            if kind != "x":
                extra = CUT if kind == "t" else KEEP
                change = KEEP if role == _EXPECTED[state] else REROLE
                best = min(best, extra + change + after[_AFTER[state]])
                if role == "s" and state == 0:
                    best = min(best, extra + after[3])
            here[state] = best
        here[3] = min(here[3], INSERT + here[2])
        here[2] = min(here[2], INSERT + here[3])
        here[0] = min(here[0], INSERT + here[2])
        out.append(here)
    return out[::-1]


def search(rows: list[str], entry: int = 0, ends: dict[int, str] = TAILS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest repair that begins in state ``entry`` and ends in one of ``ends``
    (state: what is still to insert there); the ASCII-least of equally cheap ones; None if there is none.

    A row is two letters: its role's initial (``s``, ``u``, ``a``, else ``?``) and ``x`` (must be deleted),
    ``t`` (cut off) or ``k``.
    """
    bounds, n = _least_costs(rows, ends), len(rows)
    best = (_NEVER, "")
    reached = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] < (cost, audit):
            continue
        bound = cost + bounds[i][_RELAXED[state]]
        if bound >= _NEVER or bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]:
            continue
        if i == n:
            if state in ends:
                best = min(best, (cost + INSERT * len(ends[state]), audit + ends[state]))
            continue
        role, kind = rows[i]
        moves = [(DELETE, "D", i + 1, state), (INSERT, "I", i, _AFTER[state])]
        if kind != "x":
            extra = CUT if kind == "t" else KEEP
            if role == "s" and state == 0:
                moves.append((KEEP + extra, "K", i + 1, 1))
            if role == _EXPECTED[state]:
                moves.append((KEEP + extra, "K", i + 1, _AFTER[state]))
            else:
                moves.append((REROLE + extra, "R", i + 1, _AFTER[state]))
        # the most promising goes on top, and of equals the first in ASCII
        moves.sort(key=lambda m: (m[0] + bounds[m[2]][_RELAXED[m[3]]], m[1]), reverse=True)
        for price, letter, at, to in moves:
            found = (cost + price, audit + letter)
            if (at, to) not in reached or found < reached[at, to]:
                reached[at, to] = found
                stack.append((at, to, *found))
    return best if best[0] < _NEVER else None


def _first_is_less(a: tuple, b: tuple) -> bool:
    """Whether one chain of pieces, ``(piece, rest)``, spells a lesser text than another."""
    x = y = ""
    while True:
        if not x and not y and a is b:
            return False
        while not x and a is not None:
            x, a = a
        while not y and b is not None:
            y, b = b
        if not x or not y:
            return bool(y)
        k = min(len(x), len(y))
        if x[:k] != y[:k]:
            return x[:k] < y[:k]
        x, y = x[k:], y[k:]


class Chain:
    """What follows the runs of a conversation that were added so far, last run first."""

    def __init__(self):
        self.after: dict[int, tuple[int, tuple | None]] = {}
        self.illegal, self.opens = 0, ""

    def add(self, found: list[dict], illegal: int, opens: str, closes: str) -> None:
        here: dict[int, tuple[int, tuple | None]] = {}
        for f in found:
            cost, rest = (0, None) if f["leaves"] < 0 else self.after.get(f["leaves"], (None, None))
            if cost is None:
                continue
            new = (f["cost"] + cost, (f["audit"], rest))
            old = here.get(f["enters"])
            if old is None or new[0] < old[0] or new[0] == old[0] and _first_is_less(new[1], old[1]):
                here[f["enters"]] = new
        self.illegal += illegal + bool(self.opens and closes + self.opens not in _LEGAL)
        self.after, self.opens = here, opens

    def result(self) -> tuple[int, str]:
        cost, chain = self.after[0]
        parts = []
        while chain is not None:
            part, chain = chain
            parts.append(part)
        return cost, "".join(parts)


_FOUND = pa.list_(pa.struct([("enters", pa.int8()), ("leaves", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
_FACTS = ["gaps", "blank", "duplicate", "truncated"]
_RUN = pa.schema(
    [("conv_id", pa.int64()), ("run", pa.int64()), ("found", _FOUND), ("illegal", pa.int64()), ("opens", pa.string()),
     ("closes", pa.string()), *((name, pa.int64()) for name in _FACTS)]
)
_RUN_DDL = (
    "conv_id long, run long, found array<struct<enters: byte, leaves: byte, cost: long, audit: string>>, illegal long, "
    "opens string, closes string, " + ", ".join(f"{name} long" for name in _FACTS)
)


def solve_run(rows: list[str], first: bool, last: bool) -> list[dict]:
    """The best repairs of a run for each state before it and, unless it is the last, after it."""
    out = []
    for enters in (0,) if first else (0, 1, 2, 3):
        for leaves, ends in [(-1, TAILS)] if last else [(q, {q: ""}) for q in range(4)]:
            found = search(rows, enters, ends)
            if found:
                out.append({"enters": enters, "leaves": leaves, "cost": found[0], "audit": found[1]})
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = [r["rows"][i : i + 2] for i in range(0, len(r["rows"]), 2)]
            pairs = zip(rows, rows[1:], strict=False)
            out.append(
                {name: r[name] for name in ("conv_id", "run", *_FACTS)}
                | {
                    "found": solve_run(rows, r["first"], r["last"]),
                    "illegal": sum(a[0] + b[0] not in _LEGAL for a, b in pairs),
                    "opens": rows[0][0],
                    "closes": rows[-1][0],
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_RUN)


class Repaired:
    """Applies an audit to the rows of a conversation in their order and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any = audit, 0, 0, False
        self.hash = hashlib.sha256()

    def _put(self, role: bytes, text: bytes) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(role + b":")
        self.hash.update(text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _AFTER[self.state]
            self._put(_ROLES[self.state].encode(), b"")

    def row(self, role: bytes, text: bytes) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and self.state == 0 and role[:1] == b"s":
            self.state = 1
        else:
            self.state = _AFTER[self.state]
        self._put(_ROLES[self.state].encode() if edit == "R" else role, text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


_OUT = pa.schema(
    [("conv_id", pa.int64()), *((name, pa.int64()) for name in (*_FACTS, "illegal", "cost")), ("audit", pa.string()),
     ("repaired_sha256", pa.string())]
)
_OUT_DDL = "conv_id long, " + ", ".join(f"{n} long" for n in (*_FACTS, "illegal", "cost")) + ", audit string, repaired_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation first come its runs, last first, then its rows in order."""
    chain = repaired = facts = None

    def done() -> dict:
        text = repaired or Repaired(chain.result()[1])
        cost = chain.result()[0]
        return facts | {"illegal": chain.illegal, "cost": cost, "audit": text.audit, "repaired_sha256": text.digest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["found"] is not None:
                if chain is None or repaired is not None:  # the next conversation
                    if chain is not None:
                        out.append(done())
                    chain, repaired = Chain(), None
                    facts = {name: r[name] for name in ("conv_id", *_FACTS)}
                chain.add(r["found"], r["illegal"], r["opens"], r["closes"])
            else:
                if repaired is None:
                    repaired = Repaired(chain.result()[1])
                repaired.row(r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)
    if chain is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=_OUT)


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


#: Order of a conversation's rows: turn (nulls first), then role and text (by its beginning and digest).
_ORDER = ["turn", "role", "head", "digest"]


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role`` and ``text`` are read): ``gaps``
    (missing turns between the least and the greatest), ``blank``, ``duplicate``, ``truncated`` (rows by
    their first fault), ``illegal`` (neighbours whose roles don't follow each other), ``cost``, ``audit``
    and ``repaired_sha256``.

    Null roles and texts are one space. Rows of one turn go by role, then text; null turns go first. Rows
    without a ``conv_id`` are one conversation. A role without letters has no legal place and gets another
    one or is deleted. An empty table gives no rows. ``segment`` changes how the work is cut, not the result.
    """
    blank = F.lit(" ")
    base = rows.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        F.coalesce(F.col("`role`"), blank).alias("role"),
        F.coalesce(F.col("`text`"), blank).alias("text"),
    ).withColumns({"head": F.substring("text", 1, 64), "digest": _digest(F.col("role"), F.col("text"))})
    # what the search needs of each row, numbered in order over all conversations
    ended = F.rtrim(F.col("text"), F.lit(_BLANK))
    initial = F.substring("role", 1, 1)
    short = base.select(
        "conv_id", *_ORDER,
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        (ended == "").alias("blank"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    by = ["conv_id", *_ORDER]
    short = short.repartitionByRange(*by).sortWithinPartitions(*by)
    short = stored(
        short.withColumn("pos", F.monotonically_increasing_id()).select("pos", "conv_id", "turn", "digest", "initial", "blank", "open"),
        "turns",
    )
    firsts = (
        short.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    )
    faults = short.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    faults = faults.select(
        "pos", "conv_id", "turn", "initial",
        F.when(F.col("blank"), "b").when(again, "d").when(F.col("open"), "t").otherwise("k").alias("fault"),
    )
    faults = stored(faults.withColumn("run", F.expr(f"pos div {segment}")), "faults")
    facts = faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(F.col("fault") == x[0]).alias(x) for x in ("blank", "duplicate", "truncated")),
        F.min("run").alias("from"), F.max("run").alias("to"),
    ).withColumnRenamed("conv_id", "c")
    letters = F.concat("initial", F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.col("fault")))
    runs = faults.groupBy("conv_id", "run").agg(
        # at most ``segment`` rows have one run number
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", letters.alias("l")))), lambda x: x["l"])).alias("rows")
    )
    runs = runs.join(facts, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "run", "rows", (F.col("run") == F.col("from")).alias("first"), (F.col("run") == F.col("to")).alias("last"), *_FACTS
    )
    solved = runs.mapInArrow(_solve, _RUN_DDL)
    together = solved.unionByName(
        base.select("conv_id", *_ORDER, F.col("role").cast("binary").alias("says"), F.col("text").cast("binary").alias("text")),
        allowMissingColumns=True,
    )
    together = together.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("run"), *_ORDER)
    return together.select(*_RUN.names, F.col("says").alias("role"), "text").mapInArrow(_finish, _OUT_DDL)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by ``crc32("conv_id:turn") % 20``: 0 drops the row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats the row, 4 makes it a user's. Nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("`conv_id`").cast("string"), blank), F.lit(":"), F.coalesce(F.col("`turn`").cast("string"), blank))
    rows = conversations.select(
        F.col("`conv_id`").alias("conv_id"), F.col("`turn`").alias("turn"), F.coalesce(F.col("`role`"), blank).alias("role"),
        F.coalesce(F.col("`text`"), blank).alias("text"), (F.crc32(key) % 20).alias("fault"),
    ).where("fault <> 0")
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repaired_after_damage(conversations: DataFrame, **how) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every ``conv_id`` of the table: without rows after the
    damage it has zeros, an empty audit and the hash of an empty text."""
    ids = conversations.select(F.col("`conv_id`").cast("long").alias("id")).distinct()
    found = repair(damaged(conversations), **how)
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in _OUT.names[1:]),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_after_damage(table(spark, sf_dir, "conversations"))


#: The twin keeps the best (cost, audit, text) of each state, row after row. DuckDB has no CRC-32: it is
#: made from its table of 256 values.
OP11_SQL = r"""
with recursive crc_table as materialized (
  select list(c order by n) as t from (
    select n, list_reduce(list_prepend(n::ubigint, [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, i:
      case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(n))),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(key, ''), lambda x: ord(x)::ubigint)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) % 20 as fault
  from given, crc_table),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case when fault = 1 then '' when fault = 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when fault = 3 then [1, 2] else [1] end) as copy
  from hashed where fault <> 0),
numbered as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ended,
         row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again from damaged),
rows as materialized (
  select conv_id, i, turn, role, text, left(role, 1) as initial,
         case when ended = '' then 'blank' when again > 1 then 'duplicate'
              when right(ended, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair from numbered),
facts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal from rows group by conv_id),
inserts(q, ins, put, q2) as (values
  (0, '', '', 0), (0, 'I', chr(10) || 'user:', 2), (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (1, '', '', 1), (1, 'I', chr(10) || 'user:', 2), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (2, '', '', 2), (2, 'I', chr(10) || 'assistant:', 3), (2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2),
  (3, '', '', 3), (3, 'I', chr(10) || 'user:', 2), (3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
edits(q2, edit, initial, to_role, price, q3) as (values
  (0, 'D', null, null, 2, 0), (1, 'D', null, null, 2, 1), (2, 'D', null, null, 2, 2), (3, 'D', null, null, 2, 3),
  (0, 'K', 's', null, 0, 1), (0, 'K', 'u', null, 0, 2), (1, 'K', 'u', null, 0, 2), (3, 'K', 'u', null, 0, 2),
  (2, 'K', 'a', null, 0, 3), (0, 'R', null, 'user', 1, 2), (1, 'R', null, 'user', 1, 2),
  (3, 'R', null, 'user', 1, 2), (2, 'R', null, 'assistant', 1, 3)),
paths(conv_id, i, q, b) as (
  select conv_id, 0::bigint, 0, {'cost': 0, 'audit': '', 'put': ''} from facts
  union all
  select conv_id, i, q3, min(b) from (
    select p.conv_id, r.i, e.q3,
           {'cost': p.b.cost + 5 * length(s.ins) + e.price
                    + case when r.fault = 'truncated' and e.edit <> 'D' then 5 else 0 end,
            'audit': p.b.audit || s.ins || e.edit,
            'put': p.b.put || s.put || case when e.edit = 'D' then '' else chr(10) || coalesce(e.to_role, r.role) || ':' || r.text end} as b
    from paths p join rows r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1
    join inserts s on s.q = p.q join edits e on e.q2 = s.q2
    where (e.initial is null or e.initial = r.initial) and (e.edit = 'D' or r.fault not in ('blank', 'duplicate')))
  group by conv_id, i, q3),
best as (
  select p.conv_id, min({'cost': p.b.cost + 5 * length(s.ins), 'audit': p.b.audit || s.ins, 'put': p.b.put || s.put}) as b
  from paths p join facts f on f.conv_id is not distinct from p.conv_id and f.n = p.i join inserts s on s.q = p.q
  where s.q2 in (0, 3) group by p.conv_id)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.cost, 0)::bigint as cost,
       coalesce(b.audit, '') as audit, sha256(coalesce(b.put[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) d
left join facts f on f.conv_id is not distinct from d.conv_id
left join best t on t.conv_id is not distinct from d.conv_id"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {"op11_conversation_repair": OP11_SQL}
