"""Main text of web pages: block structure, and a host's suffix array.

A page is parsed into blocks by one linear scan. Scripts, styles, forms, menus, headers, footers,
sidebars, notices, adverts and reader comments go by their elements, roles and names. Inside an
article only names that can't mean its text count. Blocks inside an article (else a main) element
are the page's own; what is left of a page without such an element is open.

A host's token streams, all blocks of each page, are concatenated, each with an end of its own. The suffix
array of that is sorted by prefix doubling, to a depth of ``DEPTH`` tokens. Neighbours that agree in
``RUN`` tokens or more are a substring of the host; one that is on a share of ``SHARE`` of the
host's distinct pages, three at least, is boilerplate for open blocks: the tokens that it covers go,
and the unique runs between stay, however short. Under RUN tokens at a block's edge, where a substring
only reaches over from the next block, stay as well. A page's own blocks are text even where some pages
share them; only those go that a substring on ``OWN_SHARE`` of ten distinct pages or more covers
whole, at the beginning or the end of the article. A page that would lose over three quarters of its
tokens so is a near copy of others, and loses none.

A host of more than ``GROUP_BYTES`` gives the same, by an array for each group of its pages. Of the groups that
have a page's stream one counts it, so counts add up. Substrings on half of SHARE of a group's pages are
reported; any other is on less than that of each group, so sums of reports bound each count. Where the bounds
leave a verdict open, the groups count those substrings by name, 64 bits of hash of RUN tokens. Verdicts then go
to every group. Per host no more is open than some 7 pages have of tokens, so no group and no verdict grows with
the host.

Defined results: null and empty pages give an empty text; a null url is a host of its own name;
repeated rows give equal results and count as one page, as do pages of equal tokens; other columns
of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

#: Tokens of a substring that counts, tokens that suffixes are sorted by, share of pages and pages of boilerplate.
RUN, DEPTH, SHARE, LEAST_PAGES = 8, 64, 0.3, 3
#: The same two for blocks inside an article.
OWN_SHARE, OWN_PAGES = 0.8, 10
#: Bytes of html that a group of a host's pages has, and large hosts that are broadcast at most.
GROUP_BYTES, LARGE_HOSTS = 1 << 20, 200_000
#: Bytes of html that a task gets, or so.
PART_BYTES = 16 << 20
#: Open elements at most; deeper ones are flat, as in browsers.
NESTED = 512
#: A tag. A quote counts after an equals sign only, and where it is closed; what was read is never read again.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
#: Elements whose content is no markup, and all that goes with its content.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
GONE = {
    *RAW, "head", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu",
    "svg", "canvas", "object", "embed", "audio", "video", "map", "math",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
BLOCKS = {
    *HEADINGS, *GONE, "html", "body", "article", "main", "section", "header", "div", "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead",
    "tbody", "tfoot", "tr", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "center", "hr",
}
#: What an opening element closes: itself and others, as far as the elements that bound the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "main", "section", "body", "nav", "aside", "div"}
#: Words of a class, id or role that mark furniture.
FURNITURE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar",
    "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "topbar", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "share", "sharing", "social", "comment", "comments",
    "comentarios", "kommentare", "commentaires", "disqus", "reply", "replies", "respond", "discussion", "newsletter", "subscribe", "signup",
    "login", "search", "related", "recommended", "recommendations", "trending", "widget", "pagination", "pager", "toolbar", "skip", "copyright",
    "complementary", "contentinfo", "dialog", "toc", "disclaimer",
}
#: Those that say so inside an article as well: as a whole name, or as the first or last word of a container's.
WITHIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "sidebar", "navbar", "breadcrumb",
    "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "share", "sharing", "comment", "comments", "comentarios", "kommentare",
    "commentaires", "disqus", "reply", "replies", "newsletter", "subscribe", "signup", "related", "recommended", "recommendations", "pagination", "pager",
}
REMARKS = {"comment", "comments", "reply", "replies", "comentarios", "kommentare", "commentaires"}
#: Elements that hold others; text elements go by a whole name only.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "span", "table", "details", "figure", "header", "article", "main"}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OWN, OPEN, OFF = 0, 1, 2


@dataclass
class Block:
    text: str
    kind: int


def words_of(names: str) -> list[str]:
    return [w.lower() for w in NAME.findall(names)]


def furniture(tag: str, attributes: str, within: bool) -> bool:
    """Whether an element's class, id or role calls it furniture, or it is hidden; within an article fewer names do."""
    if not attributes or tag in ("html", "body"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = " ".join(found.get(a, "") for a in ("class", "id", "role"))
    if tag in ("article", "main"):  # a reader's comment may be one
        return any(w and (w[0] in REMARKS or (within and w[-1] in REMARKS)) for w in map(words_of, names.split()))
    if within:
        for name in names.split():
            words = words_of(name)
            if words and ("".join(words) in WITHIN or (tag in CONTAINERS and (words[0] in WITHIN or words[-1] in WITHIN))):
                return True
        return found.get("role", "").lower() in ("navigation", "complementary", "contentinfo", "search", "dialog")
    words = set(words_of(names))
    return bool(words & FURNITURE) or (tag != "header" and "header" in words and "article" not in words)


@cache
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


def parse(page: str | None) -> list[Block]:
    """The page's blocks in order; white space in a block is one space, blocks without text are left out.

    A tag without end takes the rest of the page, and a quote without end is no quote.
    """
    page = page or ""
    out: list[tuple[str, bool, bool, bool]] = []  # text, off, in an article, in a main
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # an element and whether it goes
    count: Counter = Counter()
    flat = off = 0

    def close_block() -> None:
        if text:
            whole = SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if whole:
                own = count["article"] or count["main"]
                heading = any(count[h] for h in HEADINGS)
                out.append((whole, bool(off or (count["header"] and not (own and heading))), count["article"] > 0, count["main"] > 0))

    def pop() -> None:
        nonlocal off
        tag, goes = stack.pop()
        off -= goes
        count[tag] -= 1

    def up_to(tags: set[str], bounds: set[str]) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in bounds:
                return None
        return None

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start != at:
            text.append(html.unescape(page[at : start if start >= 0 else size]))
            if start < 0:
                break
        m = TAG.match(page, start)
        if m is None:
            next_ = page[start + 1 : start + 2]
            if next_ in ("!", "?"):
                close = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
                end = page.find(close, start + 2)
                at = end + len(close) if end >= 0 else size
            elif next_.isascii() and next_.isalpha() or (next_ == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha()):
                break  # no tag ends from here on
            elif next_ == "/":
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                text.append("<")
                at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            close_block()
        elif tag in ("td", "th"):
            text.append(" ")
        if m[1]:
            if flat:
                flat -= 1
            elif count[tag]:
                depth = up_to({tag}, set() if tag in BLOCKS else BLOCKS)
                while depth is not None and len(stack) > depth:
                    pop()
            continue
        if tag in BLOCKS and count["p"]:  # a block ends an open paragraph
            depth = up_to({"p"}, BOUNDS)
            while depth is not None and len(stack) > depth:
                pop()
        if tag in CLOSES and any(count[t] for t in CLOSES[tag]):
            depth = up_to(CLOSES[tag], BOUNDS)
            while depth is not None and len(stack) > depth:
                pop()
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = closing(tag).search(page, at)
            if tag in ("textarea", "title"):
                text.append(html.unescape(page[at : end.start() if end else size]))
                off += 1
                close_block()
                off -= 1
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if len(stack) >= NESTED:
            flat += 1
            continue
        goes = tag in GONE or furniture(tag, m[3], count["article"] > 0 or count["main"] > 0)
        stack.append((tag, goes))
        off += goes
        count[tag] += 1
    close_block()
    place = 2 if any(b[2] and not b[1] for b in out) else 3 if any(b[3] and not b[1] for b in out) else None
    return [Block(b[0], OFF if b[1] or (place and not b[place]) else OWN if place else OPEN) for b in out]


def ranks(tokens: np.ndarray, depth: int) -> list[np.ndarray]:
    """For 1, 2, 4, ... tokens up to depth, the rank of each suffix among all by so many of its first tokens.

    Tokens that end a stream have to be unique, and the last one to be an end.
    """
    out, span = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)], 1
    while span < depth:
        after = np.zeros(len(tokens), dtype=np.int64)
        after[:-span] = out[-1][span:] + 1
        out.append(np.unique(out[-1] * (len(tokens) + 1) + after, return_inverse=True)[1].astype(np.int64))
        span *= 2
    return out


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` tokens, and how many of these each shares with the one before it."""
    levels = ranks(tokens, depth)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared, last = np.zeros(len(a), dtype=np.int64), len(tokens) - 1
    whole = levels[-1][a] == levels[-1][b]
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]
        same &= (a <= last) & (b <= last)
        step = np.where(same & (shared + (1 << k) <= depth), 1 << k, 0)
        shared, a, b = shared + step, a + step, b + step
    return order, np.concatenate([[0], np.where(whole, depth, shared)])


@dataclass
class Streams:
    """The streams of pages as one line of tokens, each with an end of its own; page numbers distinct ones."""

    tokens: np.ndarray
    lengths: np.ndarray
    page: np.ndarray
    pages: int
    words: list[str]

    @classmethod
    def of(cls, streams: list[list[str]]) -> Streams:
        number: dict[str, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        lines = [[number.setdefault(w, len(number)) for w in words] for words in streams]
        pages = [seen.setdefault(tuple(line), len(seen)) for line in lines]
        lengths = np.asarray([len(x) for x in lines], dtype=np.int64)
        tokens = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray([*line, len(number) + k], dtype=np.int64) for k, line in enumerate(lines))])
        return cls(tokens, lengths, np.repeat(np.asarray(pages, dtype=np.int64), lengths + 1), len(seen), [*number])

    def spread(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and on how many distinct pages the first run tokens of each are."""
        order, shared = suffix_array(self.tokens)
        group = np.cumsum(shared < run)  # suffixes that agree in run tokens
        pairs = np.unique(group * self.pages + self.page[order])
        return order, np.bincount(pairs // self.pages, minlength=group[-1] + 1)[group]

    def names(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where run tokens of one page begin, and a hash of these tokens, the same in every group."""
        last = np.repeat(np.cumsum(self.lengths + 1), self.lengths + 1) - 1
        at = np.flatnonzero(np.arange(len(self.tokens)) + run <= last)
        known = np.asarray([xxhash.xxh3_64_intdigest(w) for w in self.words], dtype=np.uint64)
        hashes, out = known[self.tokens[self.tokens < len(known)]], np.zeros(len(at), dtype=np.uint64)
        first = at - np.repeat(np.arange(len(self.lengths)), self.lengths + 1)[at]  # as ends have no hash
        for k in range(run):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[first + k]
        return at, out.view(np.int64)

    def covered(self, level: np.ndarray, run: int) -> list[np.ndarray]:
        """Of each token of each stream the highest level of the runs that cover it, from the levels where runs begin."""
        out = np.zeros(len(self.tokens), dtype=np.int8)
        for least in (1, 2):
            at = np.flatnonzero(level >= least)
            steps = np.zeros(len(self.tokens) + 1, dtype=np.int64)
            steps[at] += 1
            steps[at + run] -= 1
            out += np.cumsum(steps)[:-1] > 0
        ends = np.cumsum(self.lengths + 1)
        return [out[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), self.lengths.tolist(), strict=True)]


def boilerplate(streams: list[list[str]], run: int = RUN, share: float = SHARE) -> list[np.ndarray]:
    """Of each token of the streams of a host's pages, 1 if a substring covers it that is boilerplate in open blocks, 2 if in own ones too."""
    whole = Streams.of(streams)
    if whole.pages < LEAST_PAGES:
        return [np.zeros(n, dtype=np.int8) for n in whole.lengths]
    order, spread = whole.spread(run)
    level = np.zeros(len(whole.tokens), dtype=np.int8)
    for least in (max(LEAST_PAGES, share * whole.pages), max(OWN_PAGES, OWN_SHARE * whole.pages)):
        level[order] += spread >= least
    level[max(0, len(level) - run + 1) :] = 0
    return whole.covered(level, run)


def left(words: list[str], marks: np.ndarray, run: int) -> list[str]:
    """An open block's words without those that runs of marks cover, be they run long or the whole block."""
    edges = np.flatnonzero(np.diff(marks > 0, prepend=False, append=False))
    out, at = [], 0
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if j - i >= run or j - i == len(words):
            out += words[at:i]
            at = j
    return out + words[at:]


def main_text(blocks: list[Block], marks: np.ndarray, run: int = RUN) -> str:
    """The text of a page's blocks, given what boilerplate() says of its tokens."""
    words = [b.text.split(" ") for b in blocks]
    ends = np.cumsum([0, *map(len, words)])
    rows = [(b, w, marks[i:j]) for b, w, i, j in zip(blocks, words, ends[:-1], ends[1:], strict=True) if b.kind != OFF]
    if not rows:
        return ""
    if rows[0][0].kind == OWN:
        first, last = 0, len(rows)
        while first < last and (rows[first][2] > 1).all():
            first += 1
        while last > first and (rows[last - 1][2] > 1).all():
            last -= 1
        kept = [w for _, w, _ in rows[first:last]]
    else:
        kept = [left(w, m, run) for _, w, m in rows]
    if 4 * sum(map(len, kept)) < sum(len(w) for _, w, _ in rows):  # a near copy of other pages
        kept = [w for _, w, _ in rows]
    return "\n\n".join(" ".join(w) for w in kept if w)


def group_texts(pages: list[str | None], run: int, share: float) -> list[str]:
    """The main texts of a group of a host's pages."""
    parsed = [parse(p) for p in pages]
    streams = [[w for b in blocks for w in b.text.split(" ")] for blocks in parsed]
    return [main_text(blocks, m, run) for blocks, m in zip(parsed, boilerplate(streams, run, share), strict=True)]


def _extract(run_length: int, share: float):
    """Rows come sorted by host and group; a group's pages are held until the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = group_texts(rows.column("html").to_pylist(), run_length, share)
            return pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        now, held = None, []
        for batch in batches:
            keys = [*zip(batch.column("host").to_pylist(), batch.column("group").to_pylist(), strict=True)]
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[i] != now and held:
                    yield done()
                    held = []
                now = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their blocks, a line each, and the blocks' kinds."""
    for batch in batches:
        parsed = [parse(p) for p in batch.column("html").to_pylist()]
        lines = pa.array(["\n".join(b.text for b in blocks) for blocks in parsed], pa.string())
        kinds = pa.array([bytes(b.kind for b in blocks) for blocks in parsed], pa.binary())
        columns = [*(batch.column(c) for c in ("page_id", "url", "host", "group")), lines, kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "group", "lines", "kinds"])


def stream_key(lines: str) -> bytes:
    return xxhash.xxh3_128_digest(lines.replace("\n", " "))


def stream(lines: str) -> list[str]:
    return lines.replace("\n", " ").split(" ") if lines else []


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array(map(stream_key, batch.column("lines").to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("group"), keys], names=["host", "group", "key"])


def counted_streams(rows: pa.Table, side: pa.Table) -> Streams:
    """The streams that a group counts, each once."""
    counts = set(side.column("keys")[0].as_py())
    lines = {key: x for x in rows.column("lines").to_pylist() if (key := stream_key(x)) in counts}
    return Streams.of([*map(stream, lines.values())])


COUNTED = "host string, name long, n long, pages long"


def counted(host: pa.Scalar, names: np.ndarray, n: np.ndarray, pages: int) -> pa.Table:
    columns = [pa.array([host.as_py()] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array([pages] * len(names), pa.int64())]
    return pa.table(columns, names=["host", "name", "n", "pages"])


def _report(run: int, share: float):
    """Substrings on half of a share of the pages that a group counts."""

    def of(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        if not side.num_rows:
            return counted(key[0], none, none, 0)
        whole = counted_streams(rows, side)
        order, spread = whole.spread(run)
        on = np.zeros(len(whole.tokens), dtype=np.int64)
        on[order] = spread
        at, names = whole.names(run)
        often = on[at] >= share / 2 * whole.pages
        names, first = np.unique(names[often], return_index=True)
        return counted(key[0], names, on[at][often][first], whole.pages)

    return of


def _count(run: int):
    """On how many of the pages that a group counts each of the substrings asked for is."""

    def of(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        if not side.num_rows:
            return counted(key[0], none, none, 0)
        whole = counted_streams(rows, side)
        at, names = whole.names(run)
        asked = np.isin(names, side.column("names").combine_chunks().flatten().to_numpy())
        found = np.unique(np.stack([names[asked], whole.page[at[asked]]]), axis=1)[0]
        return counted(key[0], *np.unique(found, return_counts=True), whole.pages)

    return of


def _decide(run: int):
    """Texts of a group's pages by the levels of its host's substrings."""

    def of(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        lines = rows.column("lines").to_pylist()
        whole = Streams.of([*map(stream, lines)])
        level = np.zeros(len(whole.tokens), dtype=np.int8)
        if side.num_rows:
            known, levels = (side.column(c).combine_chunks().flatten().to_numpy() for c in ("names", "levels"))
            order = np.argsort(known)
            known, levels = known[order], levels[order]
            at, names = whole.names(run)
            where = np.minimum(np.searchsorted(known, names), len(known) - 1)
            level[at] = np.where(known[where] == names, levels[where], 0)
        parsed = [[Block(t, k) for t, k in zip(x.split("\n"), kinds, strict=False)] for x, kinds in zip(lines, rows.column("kinds").to_pylist(), strict=True)]
        texts = [main_text(blocks, m, run) for blocks, m in zip(parsed, whole.covered(level, run), strict=True)]
        return pa.table([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return of


def _large(pages: DataFrame, large: DataFrame, parts: int, run: int, share: float) -> DataFrame:
    """(page_id, url, text) of the pages (page_id, url, html, host, group) of large hosts (host, groups).

    All steps read one exchange of the parsed pages.
    """
    kinds = dict(pages.dtypes)
    parsed = pages.mapInArrow(_read, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, group int, lines string, kinds binary")
    parsed = parsed.repartition(parts, "host", "group")

    def by_group(side: DataFrame, function, schema: str) -> DataFrame:
        side = side.repartition(parts, "host", "group")
        return parsed.groupBy("host", "group").cogroup(side.groupBy("host", "group")).applyInArrow(function, schema)

    def level(n):
        of = lambda least, part: (n >= F.greatest(F.lit(float(least)), part * F.col("distinct"))).cast("int")
        return of(LEAST_PAGES, F.lit(share)) + of(OWN_PAGES, F.lit(OWN_SHARE))

    keys = parsed.mapInArrow(_keys, "host string, group int, key binary").groupBy("host", "key").agg(F.min("group").alias("group"))
    counts = keys.groupBy("host", "group").agg(F.collect_list("key").alias("keys"), F.count("*").alias("own"))
    hosts = counts.groupBy("host").agg(F.sum("own").alias("distinct"))
    sums = by_group(counts, _report(run, share), COUNTED).groupBy("host", "name").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    # what isn't reported is on less than half of the share of a group's pages
    most = F.col("n") + F.lit(share / 2) * (F.col("distinct") - F.col("pages"))
    sums = sums.join(hosts, "host").select("host", "name", "distinct", level(F.col("n")).alias("level"), level(most).alias("most"))
    asked = sums.where("level < most").groupBy("host").agg(F.collect_list("name").alias("names"))
    exact = by_group(counts.join(asked, "host"), _count(run), COUNTED).groupBy("host", "name").agg(F.sum("n").alias("n"))
    exact = exact.join(hosts, "host").select("host", "name", level(F.col("n")).alias("level"))
    verdicts = sums.where("level = most").select("host", "name", "level").unionByName(exact).where("level > 0")
    verdicts = verdicts.groupBy("host").agg(F.collect_list(F.struct("name", "level")).alias("both"))
    verdicts = verdicts.select("host", F.col("both.name").alias("names"), F.col("both.level").alias("levels"))
    every = large.select("host", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("group"))
    return by_group(every.join(verdicts, "host"), _decide(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, share: float = SHARE, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("host", host)
    sizes = written(rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("bytes")), "html-hosts")
    large = sizes.where(F.col("bytes") > group_bytes).select("host", F.ceil(F.col("bytes") / group_bytes).alias("groups"))
    total, many = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("bytes") > group_bytes)).first()
    # a join by shuffle gives the same where the large hosts aren't few
    dealt = rows.join(F.broadcast(large) if many <= LARGE_HOSTS else large.hint("merge"), "host", "left")
    group = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("groups", F.lit(1).cast("long"))).cast("int")
    dealt = dealt.select("page_id", "url", "html", "host", group.alias("group"), "groups")
    kinds = dict(rows.dtypes)
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    together = dealt.where(F.col("groups").isNull()).drop("groups").repartition(parts, "host", "group").sortWithinPartitions("host", "group")
    out = together.mapInArrow(_extract(run, share), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    if many:
        out = out.unionByName(_large(dealt.where(F.col("groups").isNotNull()).drop("groups"), large, parts, run, share))
    return out.withColumn("n_chars", F.length("text").cast("long"))
