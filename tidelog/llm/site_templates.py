"""Main text of web pages: site templates are found by counting element subtrees per host.

Pass 1 hashes every element's subtree twice and counts, per host, the pages that hold it: with its texts, and
by its structure alone (tags, classes, ids, runs of like children as one), so that boilerplate whose words
change from page to page recurs too. Pass 2 takes the page's whole body, deletes the subtrees that recur, and
joins the blocks that are left.

What counts as recurring depends on what a subtree looks like. A menu, footer, form, advert or notice by its tag
or class recurs on two pages. Any other subtree recurs on MIN_PAGES pages and one in PAGES_SHARE of its host:
with its texts wherever it stands; by its structure if it isn't prose (paragraphs, headings, lists, quotes,
tables and what holds only such), not inside an article or main element, and a small part of its pages' text on
average. Article and main elements and what holds them are never a template, nor is prose inside one: an article may be
copied to many pages of a host. On hosts of fewer than MIN_PAGES pages nothing can be counted: there the article, and tags and classes
alone, decide. Scripts, styles, forms' controls and the like are no text anywhere.

Defined cases: a null html is an empty page; a null url belongs to the host of the empty name; rows that
repeat an id are kept side by side and count as a page each; null ids stay null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages on which a subtree recurs at least, those for one that looks like boilerplate, and the part of its host's pages, one in so many.
MIN_PAGES, HINTED_PAGES, PAGES_SHARE = 5, 2, 1_000
#: The part of their pages' text that subtrees of one structure may have on average, if the structure is to be a template.
TEXT_SHARE = 0.25
#: A host of more pages than that, and than one in common.HOT_SHARE of all, is dealt into parts.
HOST_PAGES = 4_000

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NO_TEXT = frozenset("head button select option script style template title textarea iframe object embed svg canvas audio video noscript xmp noembed noframes".split())
BOILERPLATE = frozenset("nav aside footer form dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption summary legend".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hgroup a b i em strong span small sub sup code q cite abbr mark u s br hr img time kbd samp var del ins".split())
#: An open element of the value's kinds ends where the key begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: ... but not beyond one of these.
SCOPES = frozenset("html body table ul ol dl select article section div td th".split())
#: Words of a class, id or role that mark an element as boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header topbar toolbar related recommended share sharing social comment comments respond disqus replies widget search searchform contentinfo complementary".split()
)
#: Words that don't count on an element that holds a whole page's text.
WHOLE_PAGE = frozenset("html body main article".split())

_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?:\A|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "marks", "children", "digest", "structure", "letters")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.digest, self.structure, self.letters = tag, [], 0, 0, 0
        self.marks = sorted((m[0].lower(), m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)) if attributes else []

    def is_text(self) -> bool:
        """Not of a kind that holds no text, nor hidden."""
        return self.tag not in NO_TEXT and not any(name == "hidden" for name, _ in self.marks)

    def is_hinted(self) -> bool:
        """Of a kind, class, id or role that menus, notices, adverts and the like have."""
        if self.tag in BOILERPLATE:
            return True
        return self.tag not in WHOLE_PAGE and any(not BOILERPLATE_WORDS.isdisjoint(_WORDS.findall(value.lower())) for _, value in self.marks)

    def elements(self) -> list[Element]:
        return [c for c in self.children if not isinstance(c, str)]


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or nothing, name, attributes) of every tag, and of comments and declarations with an empty name; one pass."""
    at, size = 0, len(source)
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = size if end < 0 else end + 3
            yield start, end, "", "", ""
            at = end
            continue
        name = None if source.startswith(("<!", "<?"), start) else _TAG_NAME.match(source, start + 1)
        if not name and source[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        end = name.end() if name else start + 2
        while mark := _MARK.search(source, end):
            if mark[0] == ">":
                break
            closing = source.find(mark[0], mark.end())
            end = mark.end() if closing < 0 else closing + 1
        if not mark:  # no tag ends any more
            return
        yield start, mark.end(), name[1] if name else "", name[2].lower() if name else "", source[name.end() : mark.start()] if name else ""
        at = mark.end()


def parse(source: str) -> Element:
    """The page's elements; unclosed and stray tags are mended as browsers do in the common cases."""
    root = Element("html", "")
    stack, at, opened, raw = [root], 0, Counter(), None

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    for start, end, slash, tag, attributes in tags(source):
        if raw is not None:  # script and the like end at their own end tag only
            if not (slash and tag == raw.tag):
                continue
            raw.children.append(source[at:start])
            raw, at = None, end
            continue
        if start > at:
            stack[-1].children.append(source[at:start])
        at = end
        if not tag or tag == "html":
            continue
        if slash:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in CLOSES_P:
            _end(stack, opened, close, {"p"}, SCOPES - {"div", "section", "article"} | {"button"})
        if tag in CLOSED_BY:
            _end(stack, opened, close, CLOSED_BY[tag], {"table", "ul", "ol", "dl", "select"} if tag != "li" else {"ul", "ol", "menu"})
        e = Element(tag, attributes)
        stack[-1].children.append(e)
        if tag in RAW:
            raw = e
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            stack.append(e)
            opened[tag] += 1
    (raw or stack[-1]).children.append(source[at:])
    return root


def _end(stack: list[Element], opened: Counter, close, kinds: set[str], scope: frozenset[str] | set[str]) -> None:
    """End the outermost open element of these kinds that no element of the scope separates from the innermost."""
    found, left = 0, sum(opened[k] for k in kinds)
    for k in range(len(stack) - 1, 0, -1):
        if not left:
            break
        if stack[k].tag in kinds:
            found, left = k, left - 1
        elif stack[k].tag in scope:
            break
    if found:
        close(found)


def _signed(h: int) -> int:
    return h - (1 << 63)


def digest(root: Element) -> None:
    """Set on every element the digests of its subtree, with its texts and by structure, and how long its text is.
    White space and comments don't count."""
    for x in _inside_out(root):
        own, shape, letters, before = xxhash.xxh64(repr((x.tag, x.marks))), xxhash.xxh64(repr(("shape", x.tag, x.marks))), 0, None
        for c in x.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                own.update(text or " ")
                letters += len(text)
                kind = b"text" if text else before
            else:
                own.update(c.digest.to_bytes(8, "little", signed=True))
                letters += c.letters if c.is_text() else 0
                kind = c.structure.to_bytes(8, "little", signed=True)
            if kind != before:  # a run of like children counts as one
                shape.update(kind)
                before = kind
        x.digest, x.structure, x.letters = _signed(own.intdigest()), _signed(shape.intdigest()), letters


def _inside_out(e: Element) -> list[Element]:
    order, todo = [], [e]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.elements()
    return order[::-1]


def is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or ("role", "main") in e.marks


@dataclass
class Template:
    """What is known of a host: how many pages it has, and the digests of the subtrees that recur on them."""

    pages: int
    digests: set[int]


#: What a digest stands for: a hinted element's structure, another's, or a subtree with its texts.
HINTED, STRUCTURE, EXACT = 0, 1, 2


def candidates(root: Element) -> list[tuple[Element, int, int]]:
    """(element, digest, what it stands for) of all that a template may be."""
    holds: set[int] = set()
    prose: set[int] = set()
    for e in _inside_out(root):
        inner = e.elements()
        if is_main(e) or any(id(c) in holds for c in inner):
            holds.add(id(e))
        if e.tag in PROSE and all(id(c) in prose for c in inner):
            prose.add(id(e))
    out, todo = [], [(root, False)]
    while todo:
        e, inside = todo.pop()
        if not e.is_text():
            continue
        inside = inside or is_main(e)
        if e is not root and e.tag != "body" and id(e) not in holds:
            hinted = e.is_hinted()
            if hinted:
                out.append((e, e.structure, HINTED))
            elif id(e) not in prose and not inside:
                out.append((e, e.structure, STRUCTURE))
            if hinted or not (inside and id(e) in prose):
                out.append((e, e.digest, EXACT))
        todo += [(c, inside) for c in e.elements()]
    return out


def page_digests(source: str) -> list[tuple[int, int, float]]:
    """(digest, what it stands for, its part of the page's text) of what the page may share with others of its host."""
    root = parse(source)
    digest(root)
    found: dict[tuple[int, int], float] = {}
    for e, d, kind in candidates(root):
        found[d, kind] = found.get((d, kind), 0.0) + e.letters / max(1, root.letters)
    return [(d, kind, share) for (d, kind), share in found.items()]


def mains(root: Element) -> list[Element]:
    """The outermost article elements in page order; without one, main elements; without one, the page. Hinted elements hold none."""
    for wanted in (lambda e: e.tag == "article", is_main):
        out, todo = [], [root]
        while todo:
            e = todo.pop()
            if wanted(e):
                out.append(e)
            elif e.is_text() and not e.is_hinted():
                todo += reversed(e.elements())
        if out:
            return out
    return [root]


def blocks(e: Element, deleted: set[int]) -> list[str]:
    """The texts of the element's blocks in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [(e, False)]
    while todo:
        x, done = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif done:
            end()
        elif x is e or (id(x) not in deleted and x.is_text()):
            if x.tag in BLOCKS:
                end()
                todo.append((x, True))
            elif x.tag in VOID:
                line.append(" ")
            todo += [(c, False) for c in reversed(x.children)]
    end()
    return out


def main_text(source: str, template: Template) -> str:
    """The page's main text, by what recurs on its host."""
    root = parse(source)
    if template.pages < MIN_PAGES:
        deleted = {id(e) for e in _inside_out(root) if e.is_hinted()}
        return "\n".join(b for m in mains(root) for b in blocks(m, deleted - {id(m)}))
    digest(root)
    deleted = {id(e) for e, d, _ in candidates(root) if d in template.digests}
    return "\n".join(blocks(root, deleted))


def host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """host, digest, kind, n, share: on how many of the host's pages the subtree is, and its mean part of their text; of those
    on several pages. A null digest: all pages of the host."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            hosts, found = [], []
            for name, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [(None, None, 1.0), *page_digests(source or "")]  # null: the page itself
                hosts += [name] * len(own)
                found += own
            digests, kinds, shares = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "digest": pa.array(digests, pa.int64()), "kind": pa.array(kinds, pa.int32()), "share": pa.array(shares, pa.float64())})

    found = pages.select(host("url").alias("host"), "html").mapInArrow(run, "host string, digest long, kind int, share double")
    counts = found.groupBy("host", "digest", "kind").agg(F.count("*").alias("n"), F.avg("share").alias("share"))
    return common.staged(counts.where(F.col("digest").isNull() | (F.col("n") >= HINTED_PAGES)), "subtrees")


def templates(counts: DataFrame) -> DataFrame:
    """host, digest of the subtrees that recur. A host has at most PAGES_SHARE times the mean number of a page's subtrees,
    besides those that look like boilerplate."""
    total = counts.where("digest is null").select("host", F.col("n").alias("pages"))
    often = F.col("n") >= F.greatest(F.lit(MIN_PAGES), F.col("pages") / PAGES_SHARE)
    kept = (F.col("kind") == HINTED) | (often & ((F.col("kind") == EXACT) | (F.col("share") <= TEXT_SHARE)))
    return counts.where("digest is not null").join(total, "host").where(kept).select("host", "digest").distinct()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    counts = subtree_counts(pages)
    totals = counts.where("digest is null").select("host", "n")
    hosts = F.broadcast(common.parts_of(totals, "host", F.col("n"), HOST_PAGES))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    # what is known of a host goes to each of its parts before the pages: first their number, then the digests
    nothing = [F.lit(None).cast(t).alias(k) for k, t in (("page_id", pages.schema["page_id"].dataType), ("url", "string"), ("html", "string"))]
    known = totals.select("host", F.lit(0).alias("role"), F.col("n").alias("number")).unionByName(templates(counts).select("host", F.lit(1).alias("role"), F.col("digest").alias("number")))
    known = known.join(hosts, "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "role", "number", *nothing)
    own = pages.select("page_id", "url", "html", host("url").alias("host")).join(hosts, "host", "left")
    own = own.select("host", F.pmod(F.xxhash64("page_id", "url", "html"), parts).alias("part"), F.lit(2).alias("role"), F.lit(None).cast("long").alias("number"), "page_id", "url", "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, template = None, Template(0, set())
        for b in common.slices(batches):
            out = []
            for place, role, number, source in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(6).to_pylist(), strict=True):
                if role == 0:
                    key, template = place, Template(number, set())
                elif role == 1:
                    template.digests.add(number)
                else:
                    out.append(main_text(source or "", template if place == key else Template(0, set())))
            rows = b.filter(pa.compute.equal(b.column(2), 2))
            yield pa.RecordBatch.from_pydict({"page_id": rows.column(4), "url": rows.column(5), "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})

    dealt = known.unionByName(own).repartition("host", "part").sortWithinPartitions("host", "part", "role", "number")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return dealt.select("host", "part", "role", "number", "page_id", "url", "html").mapInArrow(run, schema)
