"""Conversation repair, hard negatives and fingerprints against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import CLASH, SENTENCE, doc_rows, odd_docs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.llm import conversations, fingerprints, hard_negatives

BLANK = "[^\x20\x09-\x0d]"


# 11 -----------------------------------------------------------------------------------------------------


def every_repair(rows, roles=""):
    """All (cost, audit) of legal repairs; at most two messages are inserted at a place."""
    if not rows:
        return [(5 * k, "I" * k) for k in range(3) if legal(roles + inserted(roles, k))]
    out = []
    for k in range(3):
        here = roles + inserted(roles, k)
        (role, kind), rest = rows[0], rows[1:]
        extra = 5 if kind == "t" else 0
        tries = [(2, "D", here)]
        if kind != "x":
            tries += [(extra, "K", here + role), (1 + extra, "R", here + "u"), (1 + extra, "R", here + "a")]
        for cost, edit, after in tries:
            if re.fullmatch(r"(s?(ua)*u?)?", after):
                out += [(cost + 5 * k + c, "I" * k + edit + a) for c, a in every_repair(rest, after)]
    return out


def inserted(roles, k):
    out = ""
    for _ in range(k):
        out += "a" if (roles + out).endswith("u") else "u"
    return out


def legal(roles):
    return re.fullmatch(r"(s?(ua)+)?", roles)


def random_rows(rng, n):
    return [rng.choice("suuaaa?") + rng.choice("kkkktx") for _ in range(n)]


def test_search_finds_the_cheapest_and_least():
    rng = random.Random(1)
    for case in range(400):
        rows = random_rows(rng, case % 6)
        assert conversations.search(rows) == min(every_repair(rows)), rows


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_runs_are_put_together_exactly(segment):
    rng = random.Random(segment)
    for case in range(150):
        rows = random_rows(rng, 1 + case % 14)
        runs = [rows[i : i + segment] for i in range(0, len(rows), segment)]
        chain = conversations.Chain()
        for k in reversed(range(len(runs))):
            found = conversations.solve_run(runs[k], k == 0, k == len(runs) - 1)
            chain.add(found, 0, runs[k][0][0], runs[k][-1][0])
        assert chain.result() == conversations.search(rows), rows


def test_search_of_a_long_conversation_is_quick():
    rng = random.Random(5)
    cost, audit = conversations.search(random_rows(rng, 512))
    assert len(audit.replace("I", "")) == 512 and cost > 0
    assert conversations.search(["ux"] * 512) == (1024, "D" * 512)
    assert conversations.search(["sk"] * 512)[0] == 512


def plain_repair(rows):
    """(turn, role, text) rows of a conversation to the result's columns."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds, seen = [], set()
    for _, role, text in rows:
        letters = re.findall(BLANK, text)
        kinds.append("b" if not letters else "d" if (role, text) in seen else "k" if letters[-1] in ".!?" else "t")
        seen.add((role, text))
    count = Counter(kinds)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    short = [(i if i in ("s", "u", "a") else "?") + ("x" if k in "bd" else k) for i, k in zip(initials, kinds, strict=True)]
    cost, audit = min(every_repair(short)) if len(short) < 9 else conversations.search(short)
    lines, at, last = [], 0, ""
    for edit in audit:
        if edit == "I":
            last = "assistant" if last == "user" else "user"
            lines.append(f"{last}:")
            continue
        _, role, text = rows[at]
        at += 1
        if edit != "D":
            expected = "assistant" if last == "user" else "user"
            last = {"s": "system", "u": "user", "a": "assistant"}[role[0]] if edit == "K" else expected
            lines.append(f"{role if edit == 'K' else expected}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, digest


TALK = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Hello!"), (1, 2, "user", "How are you"), (1, 5, "assistant", "Fine."),
    (2, None, "system", "Be kind."), (2, None, None, None), (2, 3, "user", "Why?"), (2, 3, "user", "Why?"), (2, 4, "tool", "It "),
    (2, 4, "assistant", "So.\x0b "), (3, 1, "assistant", ""), (3, 1, "assistant", " \t\n"), (4, 7, "", "No role."),
    (None, 1, "user", "Who asks?"), (None, 2, "assistant", "Nobody."), (5, -3, "User", "Ü漢字!"), (5, 1 << 40, "assistant", "x" * 200_000 + "."),
    (6, None, "user", "."), (6, None, "assistant", "?"),
    *((7, i % 40, ("user", "assistant")[i % 2], f"Line {i % 60}" + "."[: i % 3]) for i in range(120)),
]


def talk(spark, rows=TALK, clash=True):
    fields = [("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]
    names = [c for c in [*CLASH, "pos", "run", "digest", "fault", "c", "first", "says", "copy"] if clash]
    fields += [(c, T.StringType()) for c in dict.fromkeys(names)]
    return spark.createDataFrame([(*r, *["?"] * (len(fields) - 4)) for r in rows], T.StructType([T.StructField(*f) for f in fields]))


def by_conversation(rows):
    out = defaultdict(list)
    for c, *rest in rows:
        out[c].append(tuple(rest))
    return out


@pytest.mark.parametrize("segment", [4, 512])
def test_repair_of_odd_conversations(spark, segment):
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(talk(spark), segment).collect()}
    assert got == {c: plain_repair(rows) for c, rows in by_conversation(TALK).items()}


def test_damage_and_repair(spark):
    damaged = []
    for c, turn, role, text in TALK:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (c, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            damaged += [row] * (1 + (kind == 3))
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in TALK}
    want |= {c: plain_repair(rows) for c, rows in by_conversation(damaged).items()}
    got = conversations.repaired_after_damage(talk(spark)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert len(damaged) < len(TALK) + 10


def test_repair_of_nothing(spark):
    assert conversations.repair(talk(spark, [])).count() == 0
    assert conversations.repaired_after_damage(talk(spark, [], False)).count() == 0
    dropped = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = conversations.repaired_after_damage(talk(spark, dropped)).collect()
    assert len(got) == len(dropped) and all(r.audit == "" and r.cost == 0 for r in got)


# 12 -----------------------------------------------------------------------------------------------------


def plain_mine(rows, is_anchor):
    """(vec_id, label, vector) rows to the result's rows, by all pairs."""
    good = [
        (i, label, [int(np.floor(256 * float(x))) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (anchor, label, v) in enumerate(good):
        if anchor is None or not is_anchor(anchor):
            continue
        score = [sum(a * b for a, b in zip(v, w, strict=False)) for _, _, w in good]
        order = sorted(range(len(good)), key=lambda j: (-score[j], good[j][0] is None, good[j][0] or 0))
        for p in [j for j in order if j != at and good[j][1] == label][:5]:
            hard = [j for j in order if good[j][1] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:3]
            out += [(anchor, good[p][0], k + 1, good[j][0], score[p], score[j]) for k, j in enumerate(hard)]
    return sorted(out, key=str)


def vectors(spark, rows):
    fields = [("vec_id", T.LongType()), ("label", T.IntegerType()), ("embedding", T.ArrayType(T.DoubleType()))]
    fields += [(c, T.StringType()) for c in ("pos", "anchor", "block", "rank", "v", "w", "score")]
    return spark.createDataFrame([(*r, *"???????") for r in rows], T.StructType([T.StructField(*f) for f in fields]))


def cloud(n, labels, seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    return [(i, i % labels, (0.3 * centres[i % labels] + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "labels", "block", "sample"), [(300, 4, 32, 40), (300, 100, 32, 40), (500, 3, 4096, 8192), (400, 2, 50, 300)])
def test_mine(spark, n, labels, block, sample):
    rows = cloud(n, labels, n + labels)
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=block, sample=sample)
    assert sorted(map(tuple, got.collect()), key=str) == plain_mine(rows, lambda i: i % 10 == 0)


def test_mine_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(120, 3, 7, 4)
    rows += [(200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]), (203, 1, [nan, 1.0, 1.0, 1.0]), (204, 1, [inf] * 4)]
    rows += [(None, 1, [0.5] * 4), (None, 2, [0.4] * 4), (210, 1, []), (220, 2, [0.5]), (230, 0, [0.2] * 7), (-10, 0, [0.3] * 4)]
    rows += [rows[0]] * 3 + [rows[13]] * 40  # repeated rows, an anchor among them
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=16, sample=30)
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == want and want


@pytest.mark.parametrize("size", [1e5, 3e6, 1e9])
def test_mine_large_components(spark, size):
    """Scores beyond 2^53 are exact; beyond a long they are its limits."""
    rows = [(i, label, [size * x for x in v]) for i, label, v in cloud(60, 2, 3, 5)]
    got = sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=16).collect()), key=str)
    want = plain_mine(rows, lambda i: i % 10 == 0)
    if size < 1e9:
        assert got == want and want
    else:  # all of them are at the limit, and none lies in a window below it
        assert got == []


def test_mine_nothing(spark):
    for rows in ([], [(1, 1, [0.5])], [(0, 1, [0.5])], [(0, 1, [0.5]), (1, 1, [0.4])]):
        assert hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).count() == 0


def test_index_loses_no_pair():
    rng = np.random.default_rng(2)
    for case in range(60):
        a, y = (np.floor(40 * rng.normal(size=(n, 20)) * rng.random(20)) for n in (7, 90))
        if case % 3 == 0:
            y[::2, :12] = 0
        full = (a @ y.T).astype(int)
        need = np.quantile(full, rng.random(), axis=1).astype(np.int64)
        ai, yi, score = hard_negatives.scores_above(a, y, need)
        got = sorted(zip(ai.tolist(), yi.tolist(), score.tolist(), strict=True))
        assert got == sorted((i, j, full[i, j]) for i in range(7) for j in range(90) if full[i, j] >= need[i])


# 13 -----------------------------------------------------------------------------------------------------


def plain_print(text):
    def h(x):
        return hashlib.md5(x.encode()).hexdigest()

    paragraphs = re.findall(r"[^\n]*\n+|[^\n]+", text)
    assert "".join(paragraphs) == text
    tree, leaves, fresh = [], [], True
    for p in paragraphs:
        sentences = re.findall(r"[^.!?]{1,100}(?:[.!?]+[ \n]*)?|[.!?]+[ \n]*", p)
        assert "".join(sentences) == p
        hashes = [h(s) for s in sentences]
        if fresh or p.startswith("#"):
            tree.append([])
        tree[-1].append((h("".join(hashes)), "".join(x[:8] for x in hashes)))
        fresh = tree[-1][-1][0][0] in "0123"
        leaves += [x[:8] for x in hashes]
    tops = [h("".join(d for d, _ in s)) for s in tree]
    body = ";".join(f"{t[:12]}={','.join(c for _, c in s)}" for t, s in zip(tops, tree, strict=True))
    return f"{h(''.join(tops))}:{body}", Counter(leaves)


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    return 2 * (a[1] & b[1]).total() / (a[1].total() + b[1].total())


def test_fingerprints(spark):
    rows = doc_rows() + [(20, "# One\ntext.\n# Two\n" * 30, "en", "a", 1), (21, "# One\ntext.\n# Two\n" * 31, "en", "a", 1)]
    got = sorted(map(tuple, fingerprints.fingerprints(odd_docs(spark, rows).repartition(3)).collect()), key=str)
    docs = [(r[0], r[1] or "") for r in rows]
    docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new = plain_print(text), plain_print(changed)
        x, y = (re.findall(r"[^\n]*\n+|[^\n]+", t) for t in (text, changed))
        first = None if text == changed else next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own[0], new[0],
                     plain_likeness(own, new), plain_likeness(own, plain_print(following)), first))
    assert got == sorted(want, key=str)


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.fingerprints(odd_docs(spark, [])).count() == 0
    (one,) = fingerprints.fingerprints(odd_docs(spark, [(5, "A b. C d!", "en", "a", 9)])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"A b. A b.").hexdigest() and one.first_edit == 0


def test_differing_branches():
    lines = [f"Paragraph {i} of this text has a number. And a second sentence.\n" for i in range(200)]
    a = fingerprints.fingerprint("".join(lines))
    changed = [*lines]
    changed[77] = "Something else stands here.\n"
    b = fingerprints.fingerprint("".join(changed))
    (section, paragraph), = fingerprints.differing(a, b)
    before = sum(len(p) for _, p in fingerprints.sections(b)[:section])
    assert before + paragraph == 77 == fingerprints.first_edit(a, b)
    longer = fingerprints.fingerprint("".join([*lines[:50], "Put in.\n", *lines[50:]]))
    assert len(fingerprints.differing(a, longer)) == 1 and fingerprints.differing(longer, a) == []
    assert fingerprints.likeness(a, longer) == 2 * 400 / 801
    assert fingerprints.differing(a, a) == [] and fingerprints.first_edit(a, a) is None
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint(None)) == 1.0
    assert fingerprints.likeness(fingerprints.fingerprint(""), a) == 0.0
    assert fingerprints.likeness(fingerprints.fingerprint(SENTENCE), fingerprints.fingerprint(SENTENCE + ".")) < 1.0
