"""HTML extraction by template deduction.

Tokens of the pages of a host that share an occurrence vector form an equivalence class.
Classes of two tokens or more, on most pages, are valid if their tokens come in one order
and each lies in one gap of the same class on all pages; they nest into the host's
template. The slot of it that holds the varying text is the article, with the other slots
that most pages fill and without the template's own texts. A page of a host without such
a slot falls back to its own markup.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.llm.shared import written

# Element names of HTML by role, and words of class, id and role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CONTAINER = frozenset("article aside body center div footer form header main nav section table tbody td tr".split())
_DROP = frozenset("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
_DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Elements whose start closes an open one of these names, up to a container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}

#: No part of a tag reaches over the next "<", and nothing is tried again, so a page is read in time that grows with its length.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|noscript|iframe|svg)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>", re.S | re.I)
#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<]*\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: A token belongs to a template if it is on at least half of a host's pages; the slot must hold so much of the varying text.
SLOT_SHARE = 0.8
#: A text of the template is on so many of a host's pages.
SKIP_SHARE = 0.8
#: Containers are told apart down to this depth; what lies deeper counts to the last one.
DEPTH = 64
#: Templates of all hosts up to this size are broadcast.
BROADCAST_BYTES = 32 << 20


class _Element:
    __slots__ = ("tag", "path", "depth", "drop", "article", "mark", "box")

    def __init__(self, tag: str, path: str, depth: int, drop: bool, article: bool, mark: int, box: int):
        self.tag, self.path, self.depth, self.drop, self.article, self.mark, self.box = tag, path, depth, drop, article, mark, box


#: A piece of text: raw text, inside dropped elements, its innermost marked element, inside a link.
_Piece = tuple[str, bool, int, bool]


def _clean(pieces: list[_Piece]) -> str:
    return " ".join(html.unescape("".join(p[0] for p in pieces)).split())


def blocks(page: str) -> Iterator[tuple[str, str, bool, bool, bool, int]]:
    """(text, path of the innermost container, dropped, inside article or main, all in links, the container's number) of every block in page order.

    A container comes as a block with text "". Pieces of dropped or marked inline elements
    are left out of their block, which stays one. A marked element is no dropped markup
    after all if it holds the page's only article or main, or most of the text; and no mark
    counts if nothing else would be left.
    """
    parents: list[int] = []
    found = list(_parsed(page, parents))
    cleared = [False] * len(parents)
    if parents:
        chars, total, free, holding = [0] * len(parents), 0, False, [False] * len(parents)
        for pieces, path, drop, _, mark, _ in found:
            if not pieces and not drop and path.rsplit("/", 1)[-1].split(".")[0] in ("article", "main"):
                if mark < 0:
                    free = True
                else:
                    holding[mark] = True
            for piece in pieces:
                if not piece[1]:
                    n = len(_clean([piece]))
                    total += n
                    if piece[2] >= 0:
                        chars[piece[2]] += n
        for k in range(len(parents) - 1, -1, -1):  # an element comes after the one around it
            if parents[k] >= 0:
                chars[parents[k]] += chars[k]
                holding[parents[k]] |= holding[k]
        held = [not free and (h or n >= SLOT_SHARE * total) for h, n in zip(holding, chars)]
        for k, parent in enumerate(parents):
            cleared[k] = held[k] and (parent < 0 or cleared[parent])
        if not any(not p[1] and (p[2] < 0 or cleared[p[2]]) and p[0].strip() for pieces, *_ in found for p in pieces):
            cleared = [True] * len(parents)
    for pieces, path, drop, article, mark, box in found:
        if not pieces:
            yield "", path, drop or mark >= 0 and not cleared[mark], article, False, box
            continue
        kept = [p for p in pieces if not p[1] and (p[2] < 0 or cleared[p[2]])]
        text = _clean(kept)
        if text:
            yield text, path, False, article, all(p[3] or not p[0].strip() for p in kept), box
        elif text := _clean(pieces):
            yield text, path, True, article, False, box


def _parsed(page: str, parents: list[int]) -> Iterator[tuple[list[_Piece], str, bool, bool, int, int]]:
    """(pieces, path, dropped, inside article or main, innermost marked element, container's number) of every block, and of every container without pieces.

    ``parents`` gets a number for each marked element: the marked one around it, or -1.
    """
    stack = [_Element("", "", 0, False, False, -1, 0)]
    pieces: list[_Piece] = []
    at, link, n_boxes = 0, False, 0

    def flush() -> Iterator[tuple[list[_Piece], str, bool, bool, int, int]]:
        nonlocal pieces
        if pieces:
            top = stack[-1]
            yield pieces, top.path, top.drop, top.article, top.mark, top.box
            pieces = []

    def marked(attributes: str, tag: str) -> int:
        if not _marked(attributes, tag):
            return stack[-1].mark
        parents.append(stack[-1].mark)
        return len(parents) - 1

    for m in _TOKEN.finditer(page):
        top = stack[-1]
        if m.start() > at:
            pieces.append((page[at : m.start()], top.drop, top.mark, link))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in _BLOCK:
            if tag == "a":
                link = not m[2]
            if tag == "br":
                pieces.append((" ", top.drop, top.mark, link))
            elif m[2]:
                # inline elements are on the stack only where they are dropped or marked, or inside one of the same name
                if top.tag == tag:
                    stack.pop()
            elif tag not in _VOID and (top.tag == tag or tag in _DROP or _marked(m[4])):
                stack.append(_Element(tag, top.path, top.depth, top.drop or tag in _DROP, top.article, marked(m[4], ""), top.box))
            continue
        yield from flush()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in _CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in _CONTAINER and stack[k].tag not in _CLOSES.get(tag, ("tr", "td")):
                break
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        drop = top.drop or tag in _DROP or tag == "header" and not article
        inner = tag in _CONTAINER and top.depth < DEPTH
        path = f"{top.path}/{tag}{_names(m[4])}" if inner else top.path
        n_boxes += tag in _CONTAINER
        stack.append(_Element(tag, path, top.depth + inner, drop, article, marked(m[4], tag), n_boxes if tag in _CONTAINER else top.box))
        if inner:
            yield [], path, drop, article, stack[-1].mark, n_boxes
    top = stack[-1]
    pieces.append((_CUT_TAG.sub("", page[at:]), top.drop, top.mark, link))
    yield from flush()


def _words(attributes: str, *names: str) -> set[str]:
    return {w for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in names for w in _WORD.findall((a or b or c).lower())}


def _marked(attributes: str, tag: str = "") -> bool:
    """Whether a class, the id or the role names something that is no part of an article: all words of a name must say so."""
    if not attributes or "=" not in attributes or tag in ("html", "body", "article", "main"):
        return False
    names = [_WORD.findall(x) for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id") for x in (a or b or c).lower().split()]
    return any(x and _DROP_WORDS.issuperset(x) for x in names) or bool(_words(attributes, "role") & _DROP_ROLES)


def _names(attributes: str) -> str:
    return "".join(f".{w}" for w in sorted(_words(attributes, "class"))) if "=" in attributes else ""


def main_text(page: str | None, slot: str | None, slots: list[str] | None = None, skip: list[int] | None = None) -> str:
    """The article of a page: what lies in the slots of its host's template, else in article or main, else in the body.

    Texts of the template (``skip``) and lists of links are left out, if other text is left;
    never inside article or main.
    """
    found = [b for b in blocks(page or "") if b[0] and not b[2]]
    inside = lambda path: path == slot or path.startswith(f"{slot}/")
    own, more = set(skip or ()), set(slots or ())
    inner = [b for b in found if slot and inside(b[1])]
    filled = [b for b in found if inside(b[1]) or b[1] in more] if inner else []
    articles = [b for b in found if b[3]]
    for part in (filled, articles, found):
        # a host's slot is no place for a page whose article is elsewhere
        if part and (part is not filled or not articles or any(b[3] for b in part)):
            return "\n".join(b[0] for b in _without_links([b for b in part if b[3] or _token(True, b[1], b[0]) not in own]) or part)
    return ""


def _without_links(part: list[tuple[str, str, bool, bool, bool, int]]) -> list[tuple[str, str, bool, bool, bool, int]]:
    """Without the link-only blocks of containers that have hardly any other text, outside article and main."""
    chars: dict[int, list[int]] = {}
    for text, _, _, article, linked, box in part:
        if not article:
            n = chars.setdefault(box, [0, 0])
            n[0] += len(text)
            n[1] += len(text) * linked
    return [b for b in part if b[3] or not b[4] or chars[b[5]][1] < SLOT_SHARE * chars[b[5]][0]]


def _token(is_text: bool, path: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{is_text:d}{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _tokens(page: str | None) -> list[tuple[int, bool, str, int, int]]:
    """(token, is text, path, occurrences, characters) of a page; a token is a container's path or a block's text at a path."""
    count: dict[tuple[bool, str, str], list[int]] = {(False, "", ""): [1, 0]}
    for text, path, drop, *_ in blocks(page or ""):
        x = count.setdefault((bool(text), path, text), [0, 0])
        x[0] += 1
        x[1] += 0 if drop else len(text)
    return [(_token(t, p, s), t, p, n, c) for (t, p, s), (n, c) in count.items()]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def nesting(page: str | None, tokens: dict[int, int]) -> dict[int, tuple[list[int], int, int]]:
    """{class: (its tokens in order, parent, gap)} of the classes on a page; ``tokens`` has the class of each token that is in one.

    The order is empty if it changes on the page. ``parent`` is the class of the shortest
    span that has all of this class between two of its tokens, ``gap`` the number of that
    gap; a class around which there is none has parent 0. Of two classes that cross, the
    one of the shorter span gets gap -1.
    """
    places: dict[int, list[int]] = {}
    order: dict[int, list[int]] = {}
    for place, (text, path, *_) in enumerate(blocks(page or "")):
        token = _token(bool(text), path, text)
        if (c := tokens.get(token)) is not None:
            places.setdefault(c, []).append(place)
            order.setdefault(c, []).append(token)
    out = {}
    by_span = sorted(places, key=lambda c: (places[c][-1] - places[c][0], c))
    for n, c in enumerate(by_span):
        cycle = list(dict.fromkeys(order[c]))
        steady = cycle * (len(order[c]) // len(cycle)) == order[c]
        own, parent, gap = places[c], 0, 0
        for other in by_span[n + 1 :]:
            at = places[other]
            if at[0] > own[-1] or at[-1] < own[0]:
                continue
            first, last = bisect_left(at, own[0]), bisect_left(at, own[-1])
            if first == last and 0 < first < len(at):
                parent, gap = other, first % len(set(order[other]))
                break
            if at[0] < own[0] < at[-1] < own[-1] or own[0] < at[0] < own[-1] < at[-1]:
                parent, gap = other, -1
                break
        out[c] = (cycle if steady else [], parent, gap)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_tokens, n_nested, slot, slots, skip): the template of every host that has one.

    A class is valid if it lies in the same gap of the same class on all pages that have it
    (or in none), and without the tokens whose place in its order changes.
    ``n_tokens`` counts the tokens of valid classes, ``n_nested`` the classes inside another;
    ``slot`` is the path of the deepest container of a valid class that holds SLOT_SHARE of
    the varying text, ``slots`` are all paths whose varying text would fill half of the
    pages, ``skip`` the texts of valid classes on SKIP_SHARE of three pages or more. A
    host's lists are as long as two pages at most. Everything is aggregated by (host,
    token) or (host, class) first, so a host with a third of all pages is spread over tasks.
    """
    schema = "host string, page long, token long, is_text boolean, path string, n int, chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [(h, p, *t) for h, p, text in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))) for t in _tokens(text)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64()))], ["host", "page", "token", "is_text", "path", "n", "chars"])

    named = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), "html")
    found = named.mapInArrow(run, schema)
    # the vector of a token: which pages have it how often, folded into one number; a sum, as repeated rows would cancel each other in a parity
    name = F.xxhash64("page", "n")
    vector = F.xxhash64(F.bit_xor(name), F.sum(F.shiftrightunsigned(name, 32)), F.count("*"))
    vectors = written(found.groupBy("host", "token", "is_text", "path").agg(vector.alias("vector"), F.count("*").alias("pages"), F.sum("chars").alias("chars")))
    # every page has the token of the outermost container once
    counted = vectors.filter("NOT is_text AND path = '' AND pages > 1").select("host", F.col("pages").alias("n_pages"))
    tokens = vectors.join(counted, "host")
    frequent = written(tokens.filter("2 * pages >= n_pages"))
    large = frequent.groupBy("host", "vector").agg(F.count("*").alias("size")).filter("size > 1")
    classed = written(frequent.join(large, ["host", "vector"]).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "vector"))).alias("tokens")))
    valid = _nested(named.select("host", "html"), classed)
    classes = frequent.join(valid, ["host", "vector", "token"])
    template = classes.groupBy("host", "n_pages").agg(F.count("*").alias("n_tokens"), F.count_distinct(F.when(F.col("parent") != 0, F.col("vector"))).alias("n_nested"))
    varying = tokens.filter("is_text AND 2 * pages < n_pages AND chars > 0").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    above = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    held = varying.filter("path <> ''").select("host", F.explode(above).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    total = varying.groupBy("host").agg(F.sum("chars").alias("total"))
    containers = classes.filter("NOT is_text").select("host", "path").distinct()
    slots = held.join(total, "host").filter(F.col("chars") >= SLOT_SHARE * F.col("total")).join(containers, ["host", "path"]).groupBy("host").agg(F.max(F.struct(F.size(F.split("path", "/")), "path")).alias("slot"))
    filled = tokens.filter("is_text AND 2 * pages < n_pages AND chars > 0").groupBy("host", "n_pages", "path").agg(F.sum("pages").alias("pages")).filter("2 * pages >= n_pages").groupBy("host").agg(F.collect_list("path").alias("slots"))
    skip = classes.filter((F.col("is_text")) & (F.col("n_pages") > 2) & (F.col("pages") >= SKIP_SHARE * F.col("n_pages")) & (F.col("chars") > 0)).groupBy("host").agg(F.collect_list("token").alias("skip"))
    return template.join(slots, "host", "left").join(filled, "host", "left").join(skip, "host", "left").select("host", "n_pages", "n_tokens", "n_nested", F.col("slot.path").alias("slot"), "slots", "skip")


def _nested(pages: DataFrame, classed: DataFrame) -> DataFrame:
    """(host, vector, token, parent) of the valid classes: tokens with one place in their class's order on all pages, if
    the class lies in one gap on all of them and two tokens or more are left. ``classed``: host, tokens {token: class}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for h, text, own in zip(*(part.column(c).to_pylist() for c in ("host", "html", "tokens"))):
                    own = dict(own)
                    found = nesting(text, own)
                    index = {t: n for cycle, _, _ in found.values() for n, t in enumerate(cycle)}
                    rows += [(h, c, t, index.get(t, -1), *found[c][1:]) for t, c in own.items() if c in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), *[pa.int64()] * 5))], ["host", "vector", "token", "place", "parent", "gap"])

    size = classed.agg(F.sum(F.octet_length("host") + 16 * F.size("tokens"))).first()[0]
    joined = pages.join(F.broadcast(classed) if (size or 0) <= BROADCAST_BYTES else classed, "host")
    met = joined.select("host", "html", "tokens").mapInArrow(run, "host string, vector long, token long, place long, parent long, gap long")
    both = [f(c).alias(f"{n}_{c}") for c in ("place", "parent", "gap") for n, f in (("low", F.min), ("high", F.max))]
    # written, as it is read twice and made by parsing all pages
    ordered = written(met.groupBy("host", "vector", "token").agg(*both).filter("low_place = high_place AND low_place >= 0 AND low_parent = high_parent AND low_gap = high_gap AND low_gap >= 0"))
    left = ordered.groupBy("host", "vector").agg(F.count("*").alias("_n")).filter("_n > 1").select("host", "vector")
    return ordered.join(left, ["host", "vector"]).select("host", "vector", "token", F.col("low_parent").alias("parent"))


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null url belongs to the host "". Repeated
    rows stay, other columns are left out, an empty table gives an empty result. Pages are
    read three times; only tokens, classes and one row for each host are shuffled, unless the templates
    are larger than BROADCAST_BYTES; then pages are joined with them by host.
    """
    host_slots = written(templates(pages).filter("slot IS NOT NULL").select("host", "slot", "slots", "skip"))
    size = host_slots.agg(F.sum(F.octet_length("host") + F.octet_length("slot") + F.octet_length(F.array_join(F.coalesce("slots", F.array()), "")) + 8 * F.size(F.coalesce("skip", F.array().cast("array<long>"))))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        host_slots = F.broadcast(host_slots)
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(host_slots, "host", "left").select("page_id", "url", "html", "slot", "slots", "skip")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [main_text(*x) for x in zip(*(part.column(c).to_pylist() for c in ("html", "slot", "slots", "skip")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return named.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
