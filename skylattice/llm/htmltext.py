"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score by where they stand (landmark, block and
link), tags score below zero; both weights are log-odds learned from labelled pages, those that mark their
article themselves.  The contiguous region with the largest sum, found in one linear scan, is
the content; it is widened to whole blocks.  Elements that are never content (menus, forms, scripts, adverts,
reader comments and the like) score nothing and give no text, so a region can reach over them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample
from .textbytes import bounded_batches

# Elements without an end tag, elements whose content is no markup, those that begin a new block,
# those that mark an article, and those that are never content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
LANDMARKS = frozenset(["article", "main"])
DROPPED = frozenset("applet aside audio button canvas datalist dialog footer form head iframe input map math menu nav noembed noframes noscript object script select style svg template textarea title video".split())
#: Words of a class, id or role that mark an element as no content.
MARKS = frozenset(
    "ad ads adv advert aside adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies disclaimer discussion disqus feedback footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promotion promotions related replies reply respond search share sharebar sharing sidebar signin signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words without learned weights, words in links without them, tags, and tags within an article that is marked as one.
WORD, LINK, TAG, INNER = 1.0, -1.0, -0.25, -0.05

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Weights:
    """Score of a word by (landmark, block, link), by landmark and by (block, link), the first known counting, and of a tag by name."""

    words: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)

    def word(self, place: tuple[str, str, bool]) -> float:
        landmark, block, link = place
        for key in (place, (landmark,) if landmark else None, (block, link)):
            if key in self.words:
                return self.words[key]
        return LINK if link and not landmark else WORD

    def tag(self, name: str, landmark: str) -> float:
        return INNER if landmark else self.tags.get(name, TAG)


@dataclass
class Token:
    """A piece of text with its words and place, or a tag (text None); ``block`` counts the blocks before it."""

    name: str
    text: str | None
    words: int
    place: tuple[str, str, bool]
    block: int


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body", *LANDMARKS) or not attributes:
        return False
    marks = MARKS if in_article else MARKS | {"header", "masthead"}
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role") and any(x.lower() in marks for x in _PARTS.findall(m[2] or m[3] or m[4] or "")):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """The place after a tag's end; quotes may hold '>', and an unclosed one ends at the next '>' or the page's end."""
    if m := _TAG_END.match(page, at):
        return m.end()
    end = page.find(">", at)
    return len(page) if end < 0 else end + 1


def tokens(page: str) -> list[Token]:
    """Texts and tags in order, without what stands in dropped elements; what is left open ends with its parent."""
    out: list[Token] = []
    stack: list[tuple[str, bool, str, str]] = []  # name, dropped, landmark, block
    at, block, link, n = 0, 0, 0, len(page)
    drop, landmark, inside = False, "", ""

    def text(low: int, high: int) -> None:
        if low < high and not drop:
            words = html.unescape(page[low:high])
            out.append(Token("", words, len(words.split()), (landmark, inside, link > 0), block))

    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            text(at, n)
            break
        follows = page[open_ + 1 : open_ + 2]
        name = _NAME.match(page, open_ + 1 + (follows == "/"))
        if not name and follows not in ("!", "?", "/"):
            text(at, open_ + 1)  # a plain sign
            at = open_ + 1
            continue
        text(at, open_)
        if not name:
            mark = "-->" if page.startswith("<!--", open_) else "]]>" if page.startswith("<![CDATA[", open_) else ">"
            end = page.find(mark, open_ + 2)
            at = n if end < 0 else end + len(mark)
            continue
        at = _tag_end(page, name.end())
        tag = name[0].lower()
        if tag in BLOCKS:
            block += 1
        if follows == "/":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            link -= tag == "a" and link > 0
        else:
            attributes = page[name.end() : at - 1]
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where a block begins
            if tag in ("li", "dt", "dd", "option", "tr") and stack and stack[-1][0] == tag:
                stack.pop()
            gone = _dropped(tag, attributes, bool(stack and stack[-1][2]))
            drop_here = gone or bool(stack and stack[-1][1])
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = _tag_end(page, close.end()) if close else n
                continue
            if tag == "br" and not drop:
                out.append(Token("br", " ", 0, (landmark, inside, link > 0), block))
            elif tag in ("td", "th") and not drop:
                out.append(Token(tag, " ", 0, (landmark, inside, link > 0), block))
            if tag not in VOID and (gone or tag in BLOCKS):
                closed = attributes.rstrip().endswith("/") and tag not in BLOCKS
                if not closed:
                    above = stack[-1] if stack else ("", False, "", "")
                    stack.append((tag, drop_here, tag if tag in LANDMARKS else above[2], tag if tag in BLOCKS else above[3]))
            link += tag == "a"
        drop, landmark, inside = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, "", "")
        if tag in BLOCKS:
            link = 0  # a link that is left open ends with its block
        if not drop:
            out.append(Token(tag, None, 0, (landmark, inside, link > 0), block))
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """First place and place after the last of the contiguous range with the largest sum, the earliest and shortest of equal ones; (0, 0) if none is above 0."""
    if not len(scores):
        return 0, 0
    total = np.append(0.0, np.cumsum(scores))
    low = np.minimum.accumulate(total)
    gain = total[1:] - low[:-1]
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end + 1


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best region, white space turned into one space, joined by line feeds."""
    found = tokens(page)
    scores = np.array([weights.tag(t.name, t.place[0]) if t.text is None else t.words * weights.word(t.place) for t in found])
    low, high = best_region(scores)
    if high == low:
        return ""
    first, last = found[low].block, found[high - 1].block
    blocks: dict[int, list[str]] = {}
    for t in found:
        if t.text is not None and first <= t.block <= last:
            blocks.setdefault(t.block, []).append(t.text)
    return "\n".join(filter(None, (" ".join("".join(x).split()) for x in blocks.values())))


def counts(page: str) -> Counter:
    """(feature, inside its article?) of a page that has one landmark's worth of words; empty for any other page."""
    found = tokens(page)
    seen: Counter = Counter()
    if not any(t.place[0] for t in found):
        return seen
    for t in found:
        inside = bool(t.place[0])
        if t.text is None:
            seen[("tag", t.name, "", False, inside)] += 1
        elif t.words:
            seen[("word", *t.place, inside)] += t.words
    return seen


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, sample: int = 2_000, least: int = 20) -> Weights:
    """Log-odds of words and tags being content, from at most ``sample`` pages that mark their article (the same on every run).

    What was seen less than ``least`` times, and everything without labelled pages, has the fixed weights.  Words of
    an article score between 0.1 and 3, others between -3 and 3, tags between -2 and -0.05.
    """
    bounded_batches(pages.sparkSession)
    labelled = pages.select(pages[id_col].cast("string").alias("id"), pages[html_col].cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(1).to_pylist():
                total.update(counts(page))
        if total:
            kind, a, b, link, inside = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(link), pa.array(inside), pa.array(list(total.values()), pa.int64())], names=["kind", "a", "b", "link", "inside", "n"])

    few = bounded_sample(labelled.select("id"), "id", sample)  # ids first: their sort carries no pages
    rows = labelled.join(F.broadcast(few.distinct()), "id", "left_semi").mapInArrow(run, "kind string, a string, b string, link boolean, inside boolean, n long")
    summed = rows.groupBy("kind", "a", "b", "link").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("no")).collect()  # as many rows as element names
    odds: dict[tuple, list[int]] = {}
    tags: dict[str, float] = {}
    for r in summed:
        if r.kind == "tag":
            if r.yes + r.no >= least:
                tags[r.a] = float(np.clip(np.log((r.yes + 1) / (r.no + 1)), -2, -0.05))
            continue
        for key in ((r.a, r.b, r.link), (r.a,) if r.a else None, (r.b, r.link)):
            if key is not None:
                both = odds.setdefault(key, [0, 0])
                both[0] += r.yes
                both[1] += r.no
    words = {}
    for key, (yes, no) in odds.items():
        if yes + no >= least:
            floor = 0.1 if len(key) == 1 or (len(key) == 3 and key[0]) else -3.0
            words[key] = float(np.clip(np.log((yes + 1) / (no + 1)), floor, 3))
    return Weights(words, tags)


def extract_text(pages: DataFrame, weights: Weights, html_col: str = "html", *, prefix: str = "") -> DataFrame:
    """pages without the html, with <prefix>text (empty if there is none) and <prefix>n_chars (its code points).

    A null or empty html has an empty text; a row stays a row, whatever its other columns hold.  Columns of pages
    that bear the new names need another ``prefix``.  Very long pages are read whole.
    """
    names = [prefix + "text", prefix + "n_chars"]
    kept = [c for c in pages.columns if c != html_col]
    if clash := set(names) & set(kept):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    source = pages.select(*[pages[c] for c in kept], pages[html_col].cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", sent.value) for page in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{names[0]}` string", f"`{names[1]}` long"])
    return source.mapInArrow(run, schema)
