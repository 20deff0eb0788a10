"""Small tables with everything odd in them, and plain versions of the operators to compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SENTENCE = "The old mill by the river was sold to a man from the town who never came back to see it again"
#: Names that the operators use inside, as further columns of the input.
CLASH = "row_ id_ t t_ h line lines words n_words kept group root slot place src part removed row_id b".split()


def doc_rows():
    base = [
        (1, SENTENCE + ".\n" + "Second line of a document that goes on for a while, as they do", "a"),
        (1, "Another text under the id that is taken already, which happens in real tables", "b"),
        (2, None, "a"),
        (3, "", "a"),
        (4, " \t\n\n \r\n", None),
        (None, "A text without an id that has enough words to be kept by the rules of the house", "b"),
        (None, "A text without an id that has enough words to be kept by the rules of the house", "b"),
        (5, "word " * 30_000 + "end", "a"),
        (6, "x" * 300_000, "c"),
        (7, SENTENCE + ".\n" + "Second line of a document that goes on for a while, as they do", "a"),
        (7, SENTENCE + ".\n" + "Second line of a document that goes on for a while, as they do", "a"),
        (8, "éÀ ß 漢字   \x00 <|endoftext|> ΑΣ İ 'll don't 12.5 km", "ü"),
        (9, "one\ntwo\n\none\nthree  four", "a"),
        (-10, " ".join(f"w{i}" for i in range(5000)), "c"),
    ]
    return [(i, x, "en", s, None if x is None else len(x)) for i, x, s in base]


def odd_docs(spark, rows=None, clash=True):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
              ("source", T.StringType()), ("n_chars", T.LongType())]
    if clash:
        fields += [(c, T.StringType()) for c in CLASH]
    rows = doc_rows() if rows is None else rows
    pad = ("?",) * (len(CLASH) if clash else 0)
    return spark.createDataFrame([tuple(r) + pad for r in rows], T.StructType([T.StructField(*f) for f in fields]))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows, threshold=0.8):
    """For (id, text) rows: the links of each row and its group (the least row number)."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, k in shared.items():
            if k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(rows))]


_TOKEN = re.compile(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")


def _fold(word):
    return "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in word)


def template(text, units, names=True):
    """(token, value) pairs; the token of a slot is its kind. Names are slots or plain words."""
    out, last, was_number = [], -1, False
    for m in _TOKEN.finditer(text or ""):
        word = _fold(m[0])
        opens = last < 0 or bool(re.search(r"[.!?:;\n]", text[last : m.start()]))
        c = m[0][0]
        capital = ("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×") and not opens
        capital = capital and names and len(m[0]) > 1 and ("a" <= m[0][1] <= "z" or m[0][1] >= "\x80")
        number = "0" <= c <= "9"
        if number:
            out.append(("<number>", (word,)))
        elif was_number and word in units:
            out.append(("<unit>", (word,)))
        elif capital and out and out[-1][0] == "<name>":
            out[-1] = ("<name>", (*out[-1][1], word))
        elif capital:
            out.append(("<name>", (word,)))
        else:
            out.append((word, None))
        last, was_number = m.end(), number
    return out


def template_windows(tokens, width, least=5):
    for at in range(len(tokens) - width + 1):
        part = tokens[at : at + width]
        if sum(v is None for _, v in part) >= min(least, width - 1):
            yield at, tuple(t for t, _ in part), tuple(v for _, v in part if v is not None)


def template_hits(docs, items, units):
    """(doc_id, text) and (item_id, text) rows to {(doc_id, text, item): (windows, item windows, slots)}."""
    known, totals = defaultdict(list), {}
    for item, text in items:
        for form in (True, False):
            tokens = template(text, units, form)
            width = min(8, len(tokens))
            if width < 4:
                continue
            own = list(template_windows(tokens, width))
            totals[item, text, form] = len(own)
            for at, key, values in own:
                known[key].append((item, text, form, at, values))
    widths = {len(k) for k in known}
    out = {}
    for doc, text in docs:
        lines = defaultdict(lambda: (set(), set()))
        for doc_form in (True, False):
            tokens = template(text, units, doc_form)
            for width in widths:
                for at, key, values in template_windows(tokens, width):
                    for item, item_text, form, item_at, item_values in known.get(key, ()):
                        places, pairs = lines[item, item_text, form, doc_form, at - item_at]
                        places.add(item_at)
                        pairs.update(zip(item_values, values, strict=True))
        for (item, item_text, form, _, _), (places, pairs) in lines.items():
            total = totals[item, item_text, form]
            same = len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
            if same and len(places) >= min(6, -(-total // 2)):
                key = (doc, text, item)
                out[key] = max(out.get(key, (0, 0, 0)), (len(places), total, len(pairs)))
    return out
