"""Main-text extraction from HTML by two passes of block rules."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words by language.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the "
        "their there they this to was we were which who will with would you "
        "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou par pas pour "
        "que qui sa se ses son sur un une vous "
        "aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer er es für ich im in ist "
        "mit nach nicht noch sich sie sind so und von war wird zu zum zur "
        "al como con de del el ella en es esta este la las lo los más me mi muy no o para pero por que se si sin "
        "su sus un una y ya"
    ).split()
)
# Element kinds.
BLOCKS = frozenset(
    (
        "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer "
        "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
        "table tbody td tfoot th thead title tr ul"
    ).split()
)
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button select head".split())
MAIN_TAGS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg textarea iframe object canvas math".split())
BOILERPLATE_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
        "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing "
        "social related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
        "comment comments discussion disqus reply replies toolbar pagination pager copyright disclaimer widget"
    ).split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN_NAMES = frozenset("article post entry content story main body".split())

TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOLD_BY = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
OPENING_QUOTE = re.compile(r"""=\s*(["'])""")
NAME_PART = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the block rules: characters, share of stop words, share of characters inside links; and by how much
    the stop-word share of blocks inside ``article`` or ``main`` is raised, and that of others lowered, if all of the
    page's undisputed text is in there."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.30
    link_high: float = 0.5
    mark: float = 0.3


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    boilerplate: bool = False
    main: bool = False
    text: str = ""
    label: str = ""

    def close(self) -> None:
        self.text = " ".join(entities.unescape("".join(self.parts)).split())

    @property
    def link_density(self) -> float:
        linked = len(" ".join(entities.unescape("".join(self.link_parts)).split()))
        return linked / len(self.text) if self.text else 0.0

    @property
    def stop_density(self) -> float:
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words) if words else 0.0


def _kind(tag: str, attrs: str) -> str:
    """'bad' for an element that holds no article text, 'main' for one that does, '' for others."""
    if tag in BOILERPLATE_TAGS:
        return "bad"
    kind = "main" if tag in MAIN_TAGS else ""
    if attrs and not attrs.isspace():
        for found in ATTRIBUTE.finditer(attrs):
            name = found[1].lower()
            if name not in TOLD_BY:
                continue
            parts = set(NAME_PART.findall((found[2] or found[3] or found[4] or "").lower()))
            if name == "hidden" or (name == "aria-hidden" and "true" in parts):
                return "bad"
            if name == "role" and parts & BOILERPLATE_ROLES:
                return "bad"
            if name == "role" and parts & {"main", "article"}:
                kind = "main"
            elif name in ("class", "id") and tag not in ("body", "html") and parts & BOILERPLATE_NAMES and not parts & MAIN_NAMES:
                return "bad"
            elif name in ("class", "id") and tag not in ("body", "html") and parts & BOILERPLATE_NAMES & {"comment", "comments", "reply", "replies"}:
                return "bad"
    return kind


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``text, tag, closing, attributes`` from left to right; one of text and tag is empty.

    Every character is looked at a bounded number of times: a search that runs to the end of the page is made once. A
    tag ends at the first > outside its quoted values; a value whose quote is never closed ends there too. What follows
    an unfinished tag or comment is dropped, as are elements that hold no text to read, with their content.
    """
    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        closing = follows == "/"
        name = TAG_NAME.match(page, start + 1 + closing)
        if not name and follows not in ("!", "?"):
            yield page[at : start + 1], "", False, ""
            at = start + 1
            continue
        yield page[at:start], "", False, ""
        if not name:
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + len(mark) + 1 if mark == "-->" else start)
            if end < 0:
                return
            at = end + len(mark)
            continue
        if last[">"] < name.end():
            return
        end = page.find(">", name.end())
        quote = OPENING_QUOTE.search(page, name.end(), end)
        while quote:
            closed = page.find(quote[1], quote.end()) if last[quote[1]] >= quote.end() else -1
            if closed < 0 or closed < end:
                quote = OPENING_QUOTE.search(page, max(closed, quote.end()), end)
                continue
            if last[">"] < closed:
                break
            end = page.find(">", closed)
            quote = OPENING_QUOTE.search(page, closed + 1, end)
        at, tag = end + 1, name[0].lower()
        if tag in RAW:
            if not closing and (done := RAW_END[tag].search(page, at)):
                at = done.end()
            elif not closing:
                return
            continue
        yield "", tag, closing, page[name.end() : end]
    yield page[at:], "", False, ""


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of text in page order, each with what encloses it."""
    blocks: list[Block] = []
    current = Block()
    open_elements: list[tuple[str, str]] = []
    open_tags: Counter[str] = Counter()
    bad = main = links = 0

    def close_from(i):
        nonlocal bad, main
        for name, kind in open_elements[i:]:
            open_tags[name] -= 1
            bad -= kind == "bad"
            main -= kind == "main"
        del open_elements[i:]

    def finish():
        nonlocal current
        if current.parts:
            current.close()
            if current.text:
                blocks.append(current)
            current = Block()
        current.boilerplate, current.main = bad > 0, main > 0

    def add(text):
        if text:
            current.parts.append(text)
            if links:
                current.link_parts.append(text)

    for text, tag, closing, attrs in tokens(page or ""):
        if not tag:
            add(text)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                finish()
            continue
        if closing:
            if open_tags[tag] > 0:
                i = len(open_elements) - 1
                while open_elements[i][0] != tag:
                    i -= 1
                close_from(i)
        else:
            if tag in ("p", "li", "td", "tr", "th", "dd", "dt", "option"):  # their end tags may be left out; one that is open ends with the next
                for i in range(len(open_elements) - 1, max(-1, len(open_elements) - 8), -1):
                    if open_elements[i][0] == tag:
                        close_from(i)
                        break
                    if open_elements[i][0] in ("ul", "ol", "table", "dl", "div", "section", "article", "main", "select"):
                        break
            kind = _kind(tag, attrs)
            open_elements.append((tag, kind))
            open_tags[tag] += 1
            bad += kind == "bad"
            main += kind == "main"
        if tag in BLOCKS or current.boilerplate != (bad > 0):
            finish()
            links = links if tag == "a" else 0
    finish()
    return blocks


def marked_share(blocks: list[Block], rules: Rules) -> float:
    """How much of the text that neither its place nor its links speak against is inside ``article`` or ``main``."""
    open_text = [b for b in blocks if not b.boilerplate and b.link_density <= rules.link_high]
    total = sum(len(b.text) for b in open_text)
    return sum(len(b.text) for b in open_text if b.main) / total if total else 0.0


def first_pass(block: Block, marked: float, rules: Rules) -> str:
    """out by place or links; good or bad by length and stop words; short or unsure where the block alone does not decide.

    ``marked`` is the page's ``marked_share``; it moves a block's stop-word share up inside the mark and down outside.
    """
    if block.boilerplate or block.link_density > rules.link_high:
        return "out"
    if block.text.startswith(("©", "(c) ", "Copyright")) and not block.main:
        return "bad"
    if len(block.text) < rules.short:
        return "short"
    density = block.stop_density + (rules.mark if block.main else -rules.mark) * marked
    if density >= rules.stop_high:
        return "good" if len(block.text) >= rules.long else "unsure"
    return "unsure" if density >= rules.stop_low else "bad"


def _nearest(labels: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """For each label the distance and value of the last decided one before it and of the first after it."""
    n = len(labels)

    def scan(order):
        found, last = [(n + 1, "")] * n, None
        for i in order:
            if last is not None:
                found[i] = (abs(i - last), labels[last])
            if labels[i] in ("good", "bad"):
                last = i
        return found

    return scan(range(n)), scan(range(n - 1, -1, -1))


def second_pass(labels: list[str]) -> list[str]:
    """Undecided blocks take the label of the nearest decided neighbour; at equal distance good wins if unsure, bad if short."""
    before, after = _nearest(labels)
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label)
        elif before[i][0] == after[i][0] and before[i][1] != after[i][1] or not before[i][1] and not after[i][1]:
            out.append("good" if label == "unsure" else "bad")
        else:
            out.append(min(before[i], after[i])[1])
    return out


def decide(blocks: list[Block], rules: Rules) -> list[str]:
    """good or bad for every block, by the two passes.

    Undecided blocks inside a mark look for neighbours inside it only, and not at blocks that are out: what stands beside
    an article or is set into it says nothing of its headings. If the mark has no decided block, its undecided ones are
    good unless the page has good text elsewhere. Undecided blocks outside look at all others.
    """
    marked = marked_share(blocks, rules)
    labels = [first_pass(b, marked, rules) for b in blocks]
    out = second_pass(["bad" if label == "out" else label for label in labels])
    inside = [i for i, (b, label) in enumerate(zip(blocks, labels)) if b.main and label != "out"]
    some_good = "good" in labels
    while inside:
        region = [inside.pop()]
        # a region goes on over blocks that are out, and ends where the mark does
        while inside and all(blocks[k].main or labels[k] == "out" and blocks[k].boilerplate for k in range(inside[-1] + 1, region[-1])):
            region.append(inside.pop())
        region.reverse()
        own = [labels[i] for i in region]
        if "good" in own or "bad" in own:
            own = second_pass(own)
        else:
            own = ["bad" if some_good else "good"] * len(own)
        for i, label in zip(region, own):
            out[i] = label
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, label in zip(blocks, decide(blocks, rules)) if label == "good")


def extract_text(pages: DataFrame, html: str = "html", rules: Rules = Rules()) -> DataFrame:
    """Adds ``text``, ``n_chars`` (code points) and ``text_sha256`` to every page; one input row gives one output row.

    Blocks inside menus, headers, footers, sidebars, notices, adverts, forms and comments, or made of links, are
    dropped. Of the others, length and stop-word density decide, and undecided blocks follow their nearest decided
    neighbour. ``article`` and ``main`` are evidence: the more of the page's text they hold, the more stop words a block
    is credited with inside them and denied outside. Whole pages are read, whatever their length, in time that grows
    with it. Null or empty html gives an empty text; repeated rows are kept; a column named like an output is
    replaced.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, rules) for page in batch[html]]
            yield batch.drop(columns=[html]).assign(
                text=texts,
                n_chars=[len(t) for t in texts],
                text_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
            )

    keep = [c for c in pages.columns if c not in ("text", "n_chars", "text_sha256") or c == html]
    source = pages.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != html]
    return source.mapInPandas(task, ", ".join([*fields, "text string", "n_chars bigint", "text_sha256 string"]))
