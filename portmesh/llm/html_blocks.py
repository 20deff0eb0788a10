"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks in elements that never hold the article (menus,
headers, footers, sidebars, forms, scripts, styles, hidden ones) are dropped with them, and so are elements
whose class, id or role is a word for such a thing. The others are classified by stop-word density, or full
sentences where the language has no list, length and link density as good, bad or undecided; undecided
blocks (mostly short ones) then inherit the label of the nearest decided blocks. Inside an article element
only link lists are bad, and blocks without a decided neighbour are good.

A name that only contains such a word (``sidebar-right``, ``related-work``) is decided by the labels: what
stands under it is dropped unless it holds most of the page's good text or, inside an article, is itself
good text that isn't a list of links. A page's article elements count as its article only if they hold most
of its good text, and so does one in a container that would be dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import table

#: Pass 1: characters of a short and of a long block, and the densities of the rules.
SHORT, LONG = 70, 200
LINKS = 0.33
STOP_LOW, STOP_HIGH = 0.25, 0.30
#: How many times the good text outside of elements with a doubtful name must be surpassed by theirs.
MOST = 2
#: Share of blocks that are all link from which an element with a doubtful name is a list of links.
LINK_LIST = 0.25
#: Share of a block's characters in full sentences, and words (or letters without spaces) of such a sentence.
SENTENCES, SENTENCE_WORDS, SENTENCE_LETTERS = 0.7, 5, 10
#: Characters between a heading and the good block that it belongs to.
HEADING_REACH = 200

# Frequent function words of some languages.
STOP_WORDS = {
    "en": """the of and to a in is it that for on was with as be by at this are from or an have not had his
        but they you which were her she he we there been has when who will more no if out so what up its
        about into than them can only other time could these may then do""",
    "fr": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont
        avec son cette aux ou mais comme on tout nous sa ses leur elle si ces entre deux fait ont""",
    "de": """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
        werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben
        nur oder aber vor zur bis mehr durch man sein""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha
        me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde""",
}
_STOP = {word for text in STOP_WORDS.values() for word in text.split()}

# Elements whose text is never article text; elements without an end tag; elements inside a
# line of text.
DROPPED = set(
    """head title script style noscript template svg math nav footer aside form button select option textarea
    iframe object embed audio video canvas dialog menu datalist input label map""".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr img""".split()
)
RAW = ("script", "style", "template", "noscript", "textarea", "iframe")
FOREIGN = ("svg", "math")
#: Elements that may stand in a head; any other one ends a head whose end tag was left out.
HEAD_LEVEL = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUNNING = HEADINGS | {"p", "li", "blockquote", "dd", "dt", "pre", "figcaption"}
MAIN = {"article", "main"}
#: Containers in which an article is a teaser or a note rather than the page's article.
ASIDE = {"aside", "nav", "footer"}
# Words that mark an element as something else than the article. As a whole class, id or role
# ``MARKS`` do so for sure, ``OUTSIDE`` outside of an article; ``DOUBTFUL`` ones and names that contain any
# of them as a part depend on the text. ``FIRM`` ones are never text of an article's own, however long.
MARKS = set(
    """ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo nav navbar
    navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus replies cookie cookies consent
    gdpr notice notices popup modal overlay newsletter subscribe subscription signup login pagination pager toolbar
    contentinfo complementary""".split()
)
OUTSIDE = {"header", "masthead", "topbar", "logo"}
DOUBTFUL = set(
    """adunit adsense promotion respond reply privacy alert alertdialog share sharing social related recommended
    recommendations widget skiplink search copyright legal disclaimer""".split()
)
FIRM = set(
    """ad ads advert adverts advertisement advertising adbox adslot adunit adsense sponsor sponsored promo comment
    comments disqus replies cookie cookies consent gdpr newsletter subscribe subscription signup login""".split()
)
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo"}
#: Words beside ``comments`` in the name of a list of reader comments or a part of one.
_COMMENTS = re.compile(
    r"(?:(?:user|reader|post|article|blog|fb|wp)-)?comments?-?(?:list|section|area|body|thread|wrapper|container|box|form|item|text|content)?"
)
_BEFORE = {"with", "has", "no", "without"}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?s:.*?)(?:</(?P=raw)\s*>|\Z)"
    # a foreign element: closed in its tag, or up to its end tag, or without one up to an HTML element
    r"|<(?P<foreign>" + "|".join(FOREIGN) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
    r"(?:(?<=/)>|>(?s:.*?)</(?P=foreign)\s*>"
    r"|>(?s:.*?)(?:(?=</?(?:p|div|h[1-6]|ul|ol|li|dl|table|pre|blockquote|body|main|article|section|header|footer|nav|aside)[\s/>])|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",  # a quote is missing
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"(?:copyright\s*)?(?:\xa9|\(c\))", re.I)
_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964]+")
#: Letters of scripts without spaces between words; each counts for three of others.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")

GOOD, BAD, SHORT_BLOCK, NEAR = "good", "bad", "short", "near"


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    inside: bool  # inside an article element
    paragraph: bool = False  # in an element of running text
    revived: int = 0  # in an article of a dropped container: 1, or 2 if that is one of ASIDE
    tag: str = ""
    marks: tuple[tuple[str, bool], ...] = ()  # doubtful names around it: name, whether inside an article
    label: str = ""


def attributes(text: str) -> dict[str, str]:
    """Names in small letters and values of a tag's attributes; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for match in _ATTR.finditer(text):
        out.setdefault(match[1].lower(), entities.unescape(match[2] or match[3] or match[4] or ""))
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    return (
        ("hidden" in attrs and attrs["hidden"].lower() != "until-found")
        or attrs.get("aria-hidden", "").lower() == "true"
        or bool(_NOT_SHOWN.search(attrs.get("style", "")))
    )


def _parts(name: str) -> set[str]:
    """The words of a name that aren't denied by the one before (``no-sidebar``)."""
    words = name.split("-")
    pairs = {a + b for a, b in zip(words, words[1:], strict=False)}
    return pairs | {w for before, w in zip(["", *words], words, strict=False) if before not in _BEFORE}


def named(attrs: dict[str, str], inside: bool) -> tuple[bool, str]:
    """Whether a class, id or role says that an element isn't part of the article, and else the first
    doubtful one."""
    known, doubtful = MARKS if inside else MARKS | OUTSIDE, ""
    for key in ("class", "id", "role"):
        for word in attrs.get(key, "").split():
            name = _CAMEL.sub("-", word).lower().replace("_", "-").strip("-")
            if name in known or name.replace("-", "") in known or _COMMENTS.fullmatch(name):
                return True, ""
            if not doubtful and _parts(name) & (known | DOUBTFUL):
                doubtful = name
    return False, doubtful


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those in dropped containers."""
    out: list[Block] = []
    # open elements that aren't inline, and how many dropped ones to take off after each
    stack: list[tuple[str, int]] = []
    drop = links = inside = 0
    seen: set[int] = set()
    revived: list[tuple[int, int]] = []  # depth and kind of articles in dropped containers
    pieces: list[str] = []
    linked: list[str] = []
    marks: list[tuple[int, tuple[str, bool]]] = []  # depth and doubtful name of open elements
    unseen: list[str] = []  # open elements in a line from a dropped one on

    def flush():
        nonlocal pieces, linked
        unseen.clear()
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                heading = any(tag in HEADINGS for tag, _ in stack[-2:])
                running = bool(stack) and stack[-1][0] in RUNNING
                kind = revived[-1][1] if revived else 0
                tag = stack[-1][0] if stack else ""
                around = tuple(mark for _, mark in marks)
                out.append(Block(text, len(" ".join("".join(linked).split())), heading, inside > 0, running, kind, tag, around))
        pieces, linked = [], []

    def close(depth: int):
        nonlocal drop, inside
        while len(stack) > depth:
            tag, dropped = stack.pop()
            drop -= dropped
            inside -= tag in MAIN
            if revived and revived[-1][0] == len(stack):
                revived.pop()
            if marks and marks[-1][0] == len(stack):
                marks.pop()

    def say(raw: str):
        if stack and stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)  # its end tag was left out
        if drop or unseen or not raw:
            return
        text = entities.unescape(raw)
        pieces.append(text)
        if links:
            linked.append(text)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            say(page[at : token.start()])
        at = token.end()
        part = "2" if token["tag2"] else ""
        tag, end, attrs = (token["tag" + part] or "").lower(), token["end" + part], token["attrs" + part]
        if not tag:
            continue
        if not end and stack and (tag == "body" or stack[-1][0] == "head" and tag not in HEAD_LEVEL):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "head":
                    close(depth)  # its end tag was left out
                    break
        if tag in INLINE or tag == "br":
            if tag == "br":
                say(" ")
            elif tag == "a":
                links = 0 if end else 1
            if tag in VOID:
                continue
            if end:
                if tag in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
            elif unseen:
                unseen.append(tag)
            elif attrs:
                known = attributes(attrs)
                sure, name = named(known, inside > 0)
                if sure or _hidden(known) or _parts(name) & ADVERTS:
                    unseen.append(tag)
            continue
        flush()
        links = 0
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "td", "th", "tr") and (
            stack[-1][0] == "p" or stack[-1][0] == tag
        ):
            close(len(stack) - 1)  # its end tag was left out
        dropped, name = tag in DROPPED or (tag in ("header", "fieldset") and not inside), ""
        if not dropped and attrs and tag not in ("html", "body"):
            known = attributes(attrs)
            if tag != "main":
                dropped, name = named(known, inside > 0)
            dropped = dropped or _hidden(known)
        change = int(dropped)
        if tag in MAIN and not dropped and not revived:
            # the page's article counts even if a class of what it stands in looked like something else
            kind = 0 if not drop else 2 if any(t in ASIDE for t, _ in stack) else 1
            if max(kind, 1) not in seen:
                seen.add(max(kind, 1))
                change = -drop
                if kind:
                    revived.append((len(stack), kind))
        if name and not dropped:
            marks.append((len(stack), (name, inside > 0)))
        stack.append((tag, change))
        drop += change
        inside += tag in MAIN
    if at < len(page):
        say(page[at:].split("<")[0] if re.match(r".*<[a-zA-Z/!][^>]*\Z", page[at:], re.S) else page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    # letters alone have no edges to take off
    hits = sum(w in _STOP or (not w.isalpha() and _EDGE.sub("", w) in _STOP) for w in words)
    return hits / len(words) if words else 0.0


def weight(text: str) -> int:
    """Characters, those of dense scripts counted three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def sentence_density(text: str) -> float:
    """Share of the characters that stand in full sentences."""
    full = at = 0
    plain = text.isascii()
    for match in _END.finditer(text):
        sentence = text[at : match.end()]
        if len(sentence.split()) >= SENTENCE_WORDS or not plain and len(_DENSE.findall(sentence)) >= SENTENCE_LETTERS:
            full += len(sentence)
        at = match.end()
    return full / len(text) if text else 0.0


def first_pass(block: Block) -> str:
    """The label from the block alone."""
    density = block.link_chars / len(block.text)
    n = weight(block.text)
    if block.inside:
        if density > LINKS and (n < SHORT or density > 0.8):
            # a paragraph may be a link; a list of links is none of the article
            return SHORT_BLOCK if block.tag == "p" and n >= SHORT else BAD
        if n < SHORT:
            return SHORT_BLOCK
        return GOOD if stop_density(block.text) >= STOP_LOW or sentence_density(block.text) >= SENTENCES else NEAR
    if density > LINKS or (n < LONG and _RIGHTS.match(block.text)):
        return BAD
    if n < SHORT:
        return BAD if block.link_chars else SHORT_BLOCK
    stop = stop_density(block.text)
    if stop >= STOP_HIGH or sentence_density(block.text) >= SENTENCES:
        return GOOD if n > LONG else NEAR
    return NEAR if stop >= STOP_LOW or n > LONG else SHORT_BLOCK


def second_pass(found: list[Block]) -> None:
    """Undecided blocks inherit from the nearest decided ones. A page's edges count as bad for loose text
    outside an article, and say nothing to others. A page without any decided block keeps them all."""
    n = len(found)
    before: list[tuple[str | None, int]] = []
    last: tuple[str | None, int] = (None, 0)
    for block in found:
        before.append((last[0], last[1] + 1))
        last = (block.label, 0) if block.label in (GOOD, BAD) else (last[0], last[1] + 1)
    after: list[tuple[str | None, int]] = [(None, 0)] * n
    last = (None, 0)
    for i in range(n - 1, -1, -1):
        after[i] = (last[0], last[1] + 1)
        last = (found[i].label, 0) if found[i].label in (GOOD, BAD) else (last[0], last[1] + 1)
    labels = [b.label for b in found]
    if not {GOOD, BAD} & set(labels):
        labels = [GOOD] * n  # nothing speaks against any of them
    reach = 0
    for i in range(n - 1, -1, -1):
        block = found[i]
        (left, far_left), (right, far_right) = before[i], after[i]
        if labels[i] in (SHORT_BLOCK, NEAR):
            if block.inside:
                labels[i] = BAD if left == right == BAD else GOOD
                reach = 0 if labels[i] == GOOD else reach + len(block.text)
                continue
            if block.paragraph or block.heading:
                left, right = left or right, right or left
            else:
                left, right = left or BAD, right or BAD
            if block.heading and right == GOOD and reach <= HEADING_REACH:
                labels[i] = GOOD
            elif left == right:
                labels[i] = left
            elif labels[i] == NEAR:
                labels[i] = GOOD
            else:
                labels[i] = left if far_left < far_right else right
        reach = 0 if labels[i] == GOOD else reach + len(block.text)
    for block, label in zip(found, labels, strict=True):
        block.label = label


def _good(found: Iterable[Block]) -> int:
    """Characters of the blocks that are good by themselves."""
    return sum(len(b.text) for b in found if b.label == GOOD)


def _decide_names(found: list[Block]) -> list[Block]:
    """The blocks without those under doubtful names that the labels speak against. A name that holds most
    of the good text says nothing, nor do further names in it until they hold most of what is left."""
    good = any(b.label == GOOD for b in found)

    def size(blocks: Iterable[Block]) -> int:
        return sum(weight(b.text) for b in blocks if b.label == GOOD) if good else sum(
            weight(b.text) for b in blocks if b.label != BAD
        )

    def own_text(mark: tuple[str, bool], under: list[Block]) -> bool:
        lists = sum(b.link_chars > 0.8 * len(b.text) for b in under)
        return mark[1] and not _parts(mark[0]) & FIRM and size(under) >= LONG and lists < LINK_LIST * len(under)

    while True:
        groups: dict[tuple[str, bool], list[Block]] = {}
        for block in found:
            if block.marks:
                groups.setdefault(block.marks[0], []).append(block)
        outside = size(b for b in found if not b.marks)
        kept = {m for m, under in groups.items() if size(under) > MOST * outside or own_text(m, under)}
        if not kept:
            return [b for b in found if not b.marks]
        # the largest first: beside it another may be little
        best = max(kept, key=lambda m: (size(groups[m]), m))
        for block in found:
            block.marks = tuple(m for m in block.marks if m != best)


def main_text(page: str | None) -> str:
    """The good blocks of a page, one to a line; white space inside a block is one space."""
    found = blocks(page or "")
    for block in found:
        block.label = first_pass(block)
    found = _decide_names(found)
    for kind in (2, 1):
        own, rest = _good(b for b in found if b.revived == kind), [b for b in found if b.revived != kind]
        if rest and (own < _good(rest) or own == _good(rest) and kind == 2):
            found = rest
    if any(b.inside for b in found):
        if _good(b for b in found if b.inside) >= _good(b for b in found if not b.inside):
            # the page says where its article is
            found = [b for b in found if b.inside]
        else:
            for block in found:
                block.inside = False
                block.label = first_pass(block)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) per row of ``pages``; ``html`` null or
    without an article gives the empty text. Rows given twice give two rows, an empty table none."""
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_blocks": op8_html_blocks}
SQL: dict[str, str] = {}
