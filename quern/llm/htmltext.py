"""HTML extraction by two passes of block rules.

Markup is cut into text blocks at block-level tags (and double line breaks); comments, scripts, styles and the like go,
entities are decoded, white space is folded. Pass one looks at a block alone: link density above `max_links` is bad; a
copyright sign is bad; shorter than `short` characters is bad with links and 'short' without; else by the density of stop
words: at least `many` is good beyond `long` characters and 'near' up to it, at least `few` is 'near', below is bad. Pass two
decides the ambiguous ones from the nearest decided blocks on either side (the page's ends count as bad): 'near' is bad only
where both are; 'short' takes their common label, else the label of the nearer one, the earlier one in a tie. First 'near'
blocks are decided, then 'short' ones, each from pass one's decided blocks (for 'short', also from decided 'near' ones).

Stop words are those of the language of the html tag if it is known, else of the language of which most are found.

A '<' out of quotes within a tag, or the page's end, shows that a quote there is none: then the tag ends at the next '>' if no
'<' comes before it, else the '<' that began it is text. Parsing takes time linear in the page's length, whatever it holds.

A head ends at its end tag or before the first element that can't be in one; svg and math may close themselves; what else is
hidden and lacks its end tag is hidden to the next block.

Nulls and edge cases: null html gives null text, empty html an empty one; broken markup never fails (an unclosed comment or
script hides the rest, a lone '<' is text); repeated rows are extracted each; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pieces, ship

STOP = {
    "en": "the of and a to in is was for on are as with he be at by that this it from or an which have not but they his had you were her all she there would their we him been has when who will more if no out so what up said its about than into them can only other do most".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son lui nous comme mais on y été dont tout être fait cette aux ses si leur elle même ces entre deux encore".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}
STOPS = {k: frozenset(v) for k, v in STOP.items()}
HIDDEN = frozenset("script style noscript template svg math head iframe object select textarea".split())
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEXT = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option', 'title'}))})(?![a-zA-Z0-9:-])", re.I)
CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in [*HIDDEN, "title"]}
LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
LINK = re.compile(r"<(/?)a(?![a-zA-Z0-9:-])", re.I)
HUGE = re.compile(r"&#[0-9]{10,};?")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
PLAIN = re.compile(r"[^<>\"']*")


@dataclass
class Tag:
    start: int
    end: int
    name: str  # lower case; empty for comments and declarations
    closing: bool = False


class Page:
    """A page's tags in order. Time is linear in its length: what a search has found to lead nowhere isn't searched again."""

    def __init__(self, markup: str):
        self.markup = markup
        self.last = markup.rfind(">")
        self.nowhere: set[int] = set()  # quotes after which a tag doesn't end
        self.unclosed: set[str] = set()  # elements without any further end tag

    def tag(self, at: int) -> Tag | None:
        """The first tag from `at`. A '<' that begins none is text; an unclosed comment goes on to the page's end."""
        markup = self.markup
        while m := START.search(markup, at):
            if m[1]:
                end = markup.find("-->", m.end())
                return Tag(m.start(), end + 3 if end >= 0 else len(markup), "")
            if m.start() > self.last:
                at = markup.find("<!--", at)  # no other tag ends any more
                return Tag(at, len(markup), "") if at >= 0 else None
            end = markup.find(">", m.end()) + 1 if m[2] else self._end(m.end())
            if end:
                return Tag(m.start(), end, (m[4] or "").lower(), bool(m[3]))
            at = m.end()
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`: at a '>' out of quotes with no '<' out of quotes before it; else at one
        before any '<'; else 0."""
        markup, begin, quotes = self.markup, at, []
        while True:
            at = PLAIN.match(markup, at).end()
            c = markup[at : at + 1]
            if c == ">":
                return at + 1
            if c in ("", "<") or at in self.nowhere:
                break
            quotes.append(at)
            at = markup.find(c, at + 1) + 1
            if not at:
                break
        self.nowhere.update(quotes)
        stop = markup.find("<", begin)
        return markup.find(">", begin, stop if stop >= 0 else len(markup)) + 1

    def after(self, tag: Tag) -> int:
        """Where the hidden element (or title) ends that the tag begins."""
        markup, name = self.markup, tag.name
        if name in ("svg", "math") and markup[tag.end - 2] == "/":
            return tag.end
        if name == "head":
            return self._after_head(tag.end)
        m = None if name in self.unclosed else CLOSE[name].search(markup, tag.end)
        if m:
            return m.end()
        self.unclosed.add(name)
        m = None if name == "script" else NEXT.search(markup, tag.end)
        return m.start() if m else len(markup)

    def _after_head(self, at: int) -> int:
        end = at  # of the last element seen
        while t := self.tag(at):
            at = t.end
            if t.closing:
                if t.name == "head":
                    return at
                if t.name == "body":
                    return t.start
                continue
            if t.name and t.name not in HEAD:
                return t.start
            end = at = self.after(t) if t.name in CLOSE and t.name != "head" else at
        return end


def blocks(markup: str) -> list[tuple[str, int]]:
    """(text, characters within links) of each block that has text."""
    return parse(markup)[0]


def parse(markup: str) -> tuple[list[tuple[str, int]], str | None]:
    """The blocks, and the language of the html tag. A link goes on over block tags if its end tag comes before another link."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    linked, breaks = 0, 0
    link, across = False, False
    lang: str | None = None

    def end() -> None:
        nonlocal linked
        whole = SPACES.sub(" ", "".join(text)).strip()
        if whole:
            out.append((whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            if "&" in raw:
                raw = entities.unescape(HUGE.sub("\ufffd", raw))
            text.append(raw)
            folded = len(SPACES.sub(" ", raw).strip())
            if folded:
                breaks = 0
            if link:
                linked += folded

    page, at = Page(markup), 0
    while t := page.tag(at):
        take(markup[at : t.start])
        at = t.end
        if not t.name:
            continue
        if t.name in HIDDEN and not t.closing:
            at = page.after(t)
            text.append(" ")
        elif t.name == "a":
            link = not t.closing
            if link:
                m = LINK.search(markup, at)
                across = bool(m and m[1])
        elif t.name == "br":
            text.append(" ")
            breaks += 1
            if breaks == 2:
                end()
        elif t.name in BLOCK:
            end()
            breaks = 0
            link = link and across
            if t.name == "html" and lang is None and (m := LANG.search(markup, t.start, t.end)):
                lang = m[1].lower()
    take(markup[at:])
    end()
    return out, lang


def stop_density(words: list[str], lang: str | None) -> float:
    if not words:
        return 0.0
    lists = [STOPS[lang]] if lang in STOPS else STOPS.values()
    return max(sum(map(s.__contains__, words)) for s in lists) / len(words)


def first_pass(found: list[tuple[str, int]], lang: str | None, short: int = 70, long: int = 200, few: float = 0.15, many: float = 0.2, max_links: float = 0.2) -> list[str]:
    out = []
    for text, linked in found:
        n = len(text)
        if linked / n > max_links or "©" in text:
            out.append("bad")
        elif n < short:
            out.append("bad" if linked else "short")
        else:
            d = stop_density(WORD.findall(text.lower()), lang)
            out.append(("good" if n > long else "near") if d >= many else "near" if d >= few else "bad")
    return out


def _neighbours(labels: list[str]) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """For each block, label and distance of the nearest decided block before and after it."""
    n = len(labels)
    before, after = [("bad", 0)] * n, [("bad", 0)] * n
    last = ("bad", -1)
    for i in range(n):
        before[i] = (last[0], i - last[1])
        if labels[i] in ("good", "bad"):
            last = (labels[i], i)
    last = ("bad", n)
    for i in range(n - 1, -1, -1):
        after[i] = (last[0], last[1] - i)
        if labels[i] in ("good", "bad"):
            last = (labels[i], i)
    return list(zip(before, after, strict=True))


def second_pass(labels: list[str]) -> list[str]:
    near = [("bad" if a[0] == b[0] == "bad" else "good") if x == "near" else x for x, (a, b) in zip(labels, _neighbours(labels), strict=True)]
    return [(a[0] if a[0] == b[0] or a[1] <= b[1] else b[0]) if x == "short" else x for x, (a, b) in zip(near, _neighbours(near), strict=True)]


def extract(markup: str) -> tuple[str, int, int]:
    """(kept blocks joined by line feeds, blocks, kept blocks)."""
    found, lang = parse(markup)
    labels = second_pass(first_pass(found, lang))
    kept = [t for (t, _), x in zip(found, labels, strict=True) if x == "good"]
    return "\n".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_kept) for each page."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html", 2 << 20):
            got = [(None, 0, 0) if h is None else extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([t for t, _, _ in got], pa.string()), pa.array(np.array([n for _, n, _ in got], np.int64)), pa.array(np.array([n for _, _, n in got], np.int64))], ["page_id", "text", "n_blocks", "n_kept"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, text string, n_blocks long, n_kept long")
