"""Main text of web pages by two passes of block rules.

Pass 1 classifies each block of a page by its place in the page, its length, its link density and
its density of stop words: good, bad, or undecided (short, or long without stop words). Pass 2
gives an undecided block the label of its nearest decided neighbour in the same region, a region
being one article or the page outside of articles; blocks that are bad for their place alone
(menus, adverts, comments, ..., lists of links inside an article) are no neighbours.

A class or id marks a place if each of its parts is a known mark or a word of layout
("cookie-notice", "sidebar-left"). With any other part ("related-work") it only makes short and
link-dense blocks bad; after "no", "has" and the like it marks nothing ("has-sidebar"). Marks of a
container that holds MOST of the page's text are passed over. The stop words are those of four
languages; a page that has hardly any of them is judged by length and links alone.

Defined results: null, empty and tagless html are handled alike (a tagless page is one block
outside any article); a page without any decided block keeps its undecided ones; unclosed and
misnested tags close with their container; character references are decoded once, without another
look for tags; pages of any length are read whole; null and repeated ids are ids like others, and
equal rows give equal results; an empty table gives no rows. Only id, url and html are read, so
other columns may have any name.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, and words that mark places without article text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("aside button dialog fieldset footer form head header iframe menu nav object select title".split())
NESTED = OUTSIDE | frozenset("article blockquote body center details div dl figure html main ol p section table tbody td th tr ul li".split())
MAIN = frozenset(["article", "main"])
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())
LAYOUT = frozenset("area banner bar block body bottom box btn button container content desktop fixed form global group hidden icons inner items left links list main mobile module overlay page panel primary right row secondary section site slot sticky text top unit wrap wrapper".split())
UNLIKE = frozenset("has is no not with without".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "a an and are as at be but by for from had has have he her his in is it its not of on only or she that the their there they this to was were which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en es esta este ha la las lo los más me no o para pero por que se ser si sin sobre son su sus un una y ya".split()
)
LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 0.15, 0.30, 0.33
#: Stop words of a page's long blocks below which it is in another language; share of a page's text that no mark rules out.
KNOWN, MOST = 0.03, 2 / 3
GOOD, BAD, OPEN, PLACE = "good", "bad", "open", "place"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(?P<drawn>svg|math)\b[^>]*>(?:.*?</(?P=drawn)\b[^>]*>)?"
    r"|<(?P<raw>script|style|noscript|template|textarea)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")


def marks(rest: str) -> str:
    """What the classes, id and role of a tag say of its text: comment, bad, weak or nothing."""
    found = ""
    if "=" in rest:
        for m in ATTRIBUTE.finditer(rest):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
                if parts and parts[0] in UNLIKE:
                    continue
                if COMMENTS.intersection(parts):
                    return "comment"
                if MARKS.intersection(parts):
                    found = "bad" if found == "bad" or all(w in MARKS or w in LAYOUT or w.isdigit() for w in parts) else "weak"
    return found


class _Page:
    """Blocks of one page: [text, link characters, region, marks that make its place bad]."""

    def __init__(self):
        self.blocks, self.text, self.linked = [], [], 0
        self.stack: list[tuple[str, str]] = []  # open elements: name, and main, hard, weak, bad with a number, or ""
        self.regions, self.region, self.marks, self.bad = 0, 0, 0, ()
        self.link = -1  # how many elements are open outside the link that is open

    def place(self) -> None:
        """Where the open elements put the text that follows."""
        self.region, self.bad = 0, ()
        hard = False
        for name, kind in self.stack:
            if kind.startswith("main"):
                if not hard:
                    self.region, self.bad = int(kind[4:]), ()
            elif kind:
                self.bad += (kind,)
                hard |= kind == "comment" or name in OUTSIDE

    def flush(self) -> None:
        words = " ".join(self.text).split() if len(self.text) > 1 else self.text[0].split() if self.text else None
        if words:
            self.blocks.append((" ".join(words), self.linked, self.region, self.bad))
        self.text, self.linked = [], 0

    def opened(self, name: str, rest: str) -> None:
        if self.stack and self.stack[-1][0] == "p":  # any block ends a paragraph
            self.shut(len(self.stack) - 1)
        if name in ("li", "td", "th", "tr"):  # their end tags may be left out
            self.closed(name, ("ul", "ol", "table"))
        if name not in NESTED:
            return
        found = marks(rest)
        if found == "comment":
            kind = "comment"
        elif name in MAIN:
            self.regions += 1
            kind = f"main{self.regions}"
        elif name in ("html", "body"):
            kind = ""
        elif name == "header" and any(k.startswith("main") for _, k in self.stack):
            kind = ""
        elif name in OUTSIDE:
            kind = "tag"
        else:
            self.marks += 1
            kind = f"{found}{self.marks}" if found else ""
        self.stack.append((name, kind))
        self.place()

    def shut(self, k: int) -> None:
        """Close the open elements from the k-th on, and a link that began inside them."""
        del self.stack[k:]
        if self.link > k:
            self.link = -1
        self.place()

    def closed(self, name: str, within: list[str] | tuple = ()) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.shut(k)
                return
            if self.stack[k][0] in within:
                return


def blocks(page: str) -> list[tuple[str, int, int, str]]:
    """Text, link characters, region and place of each block; the place is bad, weak or nothing."""
    p, at = _Page(), 0
    joined: list[str] = []  # pieces of the text at hand that no markup but inline elements parts

    def add(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            joined.append(piece)
            if p.link >= 0:
                p.linked += len(piece.strip())

    def part() -> None:
        if joined:
            p.text.append("".join(joined))
            joined.clear()

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                p.link = -1 if m["end"] else len(p.stack)
            continue
        part()
        if name == "br":
            continue
        p.flush()
        if m["end"]:
            if name not in NESTED and p.link == len(p.stack):
                p.link = -1  # a heading's end, say, ends a link that was left open in it
            p.closed(name)
        else:
            p.opened(name, m["rest"])
    add(page[at:])
    part()
    p.flush()
    return [(text, linked, region, worst(bad, overruled)) for overruled in [_overruled(p.blocks)] for text, linked, region, bad in p.blocks]


def _overruled(found: list[tuple]) -> set[str]:
    """Marks of containers that hold most of the page's text."""
    held: dict[str, int] = {}
    for text, linked, _, bad in found:
        for kind in bad:
            held[kind] = held.get(kind, 0) + len(text) - linked
    total = sum(len(text) - linked for text, linked, _, _ in found)
    return {kind for kind, n in held.items() if kind.startswith("bad") and n > MOST * total}


def worst(kinds: tuple[str, ...], overruled: set[str]) -> str:
    kinds = [k for k in kinds if k not in overruled]
    return "bad" if any(not k.startswith("weak") for k in kinds) else "weak" if kinds else ""


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(found: list[tuple[str, int, int, str]]) -> list[str]:
    has_main = any(region and place != "bad" for _, _, region, place in found)
    density = [stop_density(text) if len(text) >= LONG else 0.0 for text, _, _, _ in found]
    spoken = [(d, len(b[0])) for d, b in zip(density, found, strict=True) if len(b[0]) >= LONG and b[3] != "bad"]
    known = sum(d * n for d, n in spoken) >= KNOWN * sum(n for _, n in spoken)
    labels = []
    for (text, linked, region, place), d in zip(found, density, strict=True):
        if place == "bad" or has_main and not region:
            labels.append(PLACE)
        elif linked > LINKS * len(text):
            labels.append(PLACE if region or place else BAD)
        elif len(text) < LONG:
            labels.append(PLACE if place else OPEN)
        elif not known or d >= (STOP_LOW if region else STOP_HIGH):
            labels.append(GOOD)
        else:
            labels.append(OPEN if region or d >= STOP_LOW else BAD)
    return labels


def second_pass(found: list[tuple[str, int, int, str]], labels: list[str]) -> list[bool]:
    """Which blocks belong to the main text."""
    if GOOD not in labels and BAD not in labels:
        return [label == OPEN for label in labels]
    far = 1 << 60
    before, after = [(far, None)] * len(found), [(far, None)] * len(found)
    for order, near in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last: dict[int, list] = {}
        for k in order:
            region = found[k][2]
            state = last.setdefault(region, [0, None, None])  # blocks seen, position and label of the last decided
            if labels[k] == PLACE:
                continue
            state[0] += 1
            if labels[k] in (GOOD, BAD):
                state[1:] = [state[0], labels[k]]
            elif state[2]:
                near[k] = (state[0] - state[1], state[2])
    keep = []
    for k, label in enumerate(labels):
        if label == OPEN:
            (a, x), (b, y) = before[k], after[k]
            if x is None and y is None:
                keep.append(bool(found[k][2]))
            else:
                keep.append(GOOD in ([x] if a < b else [y] if b < a else [x, y]))
        else:
            keep.append(label == GOOD)
    return keep


def main_text(page: str) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, keep in zip(found, second_pass(found, first_pass(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # bounds what is held besides the batch
                part = batch.slice(k, 64)
                texts = [main_text(t.as_py() or "") for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
