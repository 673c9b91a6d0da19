"""Main text of web pages by nearest-URL differencing: each page is compared with the pages that stand next to it when the
pages of its host are sorted by URL path; lines that a longest common subsequence finds in both are template."""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import by_listing, free_name, materialise, read

#: Elements whose text is never content; those that are furniture unless the page's text is in them; those that are void; those
#: that stand within a block of text.
DROPPED = frozenset("script style noscript template iframe object svg math canvas button select option textarea input label head title".split())
BOXES = frozenset("nav header footer aside form fieldset dialog menu".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Whole names (of class, id or role) of furniture, which may differ from page to page so that differencing cannot see it.
FURNITURE = frozenset("""
ad ads ad-slot ad-container advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments comment-list comments-area complementary consent contentinfo cookie cookies
cookie-banner cookie-notice cookie-consent discussion disqus feedback footer header login main-nav masthead menu modal nav navbar navigation nav-bar newsletter notice notices notification outbrain page-footer
page-header pagination paywall popup promo promoted reader-comments recommended related related-posts replies reply respond responses search share share-buttons sharing sidebar side-bar signup site-footer
site-header site-nav skip skip-link social social-share sponsor sponsored sponsors subscribe subscription taboola toolbar widget widgets
""".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE = frozenset("article article-body article-content post-body post-content entry-content main-content story main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|([^<]++|<)", re.S)
#: From the first tag on whose quotes don't close, quotes mean nothing.
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.S)
ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
SPACES = re.compile(r"\s+")
#: An element of one of these tags ends a paragraph that was left open.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k: m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw) if (k := m[1].lower()) in ATTRIBUTES}


class _Stack:
    """Open elements, each with what held before it; how many of each tag are open, and where paragraphs and those elements
    are that keep a paragraph from being ended."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, tuple[int, ...]]] = []
        self.count: Counter[str] = Counter()
        self.p: list[int] = []
        self.walls: list[int] = []

    def push(self, tag: str, dropped: bool, article: bool, boxes: tuple[int, ...]) -> None:
        if tag == "p":
            self.p.append(len(self.open))
        elif tag == "div" or tag in ARTICLE_TAGS:
            self.walls.append(len(self.open))
        self.count[tag] += 1
        self.open.append((tag, dropped, article, boxes))

    def close(self, tag: str) -> tuple[bool, bool, tuple[int, ...]]:
        """End the innermost `tag`, which must be open, and all in it; what held before it."""
        while True:
            last, dropped, article, boxes = self.open.pop()
            self.count[last] -= 1
            for places in (self.p, self.walls):
                if places and places[-1] == len(self.open):
                    places.pop()
            if last == tag:
                return dropped, article, boxes

    def paragraph_ends(self) -> bool:
        return bool(self.p) and not (self.walls and self.walls[-1] > self.p[-1])


#: Furniture within furniture is told apart up to this depth; what is deeper belongs to the box around it.
MOST_BOXES = 32
#: A line with its flag of standing in an article element, and the furniture boxes it stands in: number, and whether the article
#: element began inside of the box.
Line = tuple[str, bool, tuple[tuple[int, bool], ...]]


def without_boxes(lines: list[Line], forms: set[int]) -> list[tuple[str, bool]]:
    """The lines outside of furniture. A box is none if it holds most of the text in article elements: then what stands in these
    stays, and what stands around them goes. A form is none if it holds most of the page's text. And if nothing would be left, the
    box with the most text is none, so that no page with text comes out empty."""
    size, article, inside = Counter(), 0, Counter()
    for text, a, boxes in lines:
        article += a * len(text)
        for k, own in boxes:
            size[k] += len(text)
            inside[k] += own * len(text)
    whole = sum(len(text) for text, *_ in lines)
    around = {k for k in size if inside[k] * 2 > article > 0}  # only the articles in it are content
    open_ = {k for k in size if k in forms and size[k] * 2 > whole and k not in around}

    def kept() -> list[tuple[str, bool]]:
        return [(t, a) for t, a, boxes in lines if all(k in open_ or k in around and own for k, own in boxes)]

    while not (out := kept()) and (rest := [k for k in size if k not in open_]):
        open_.add(max(rest, key=lambda k: (size[k], -k)))
    return out


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """The page's lines (blocks of text, white space turned into one space, character references decoded) outside of
    elements that never hold content and of furniture, and whether each lies in an article element. Unclosed elements end with
    their parent, an open head with the first element or text that can't be in it; an end tag without start is ignored. Null:
    none. Time grows with the page's length, however broken it is."""
    out: list[Line] = []
    stack = _Stack()
    dropped = article = False
    boxes: tuple[int, ...] = ()
    made, forms, begun = 0, set(), 0  # boxes so far; those that are forms; how many boxes were open where the article began
    text: list[str] = []

    def flush() -> None:
        if text:
            line = SPACES.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append((line, article, tuple((k, article and i < begun) for i, k in enumerate(boxes))))
            text.clear()

    page, at, token = page or "", 0, TOKEN
    last = page.rfind(">")
    while at < len(page):
        if at > last:  # no tag ends any more
            if not dropped:
                text.append(page[at:])
            break
        m = token.match(page, at)
        if m[0] == "<" and token is TOKEN and re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            token = UNQUOTED
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[4] and dropped and stack.open[-1][0] == "head" and not m[4].isspace():
                dropped, article, boxes = stack.close("head")
            if m[4] and not dropped:
                text.append(m[4])
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if stack.count[tag]:
                dropped, article, boxes = stack.close(tag)
            continue
        if stack.count["head"] and tag not in IN_HEAD:
            dropped, article, boxes = stack.close("head")
        if tag in VOID or SELF_CLOSED.search(m[3]):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and stack.paragraph_ends():
            dropped, article, boxes = stack.close("p")
        a = _attributes(m[3]) if m[3] else {}
        names = {n for k in ("class", "id", "role") for n in a.get(k, "").lower().split()}
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        furniture = names & FURNITURE and tag not in ARTICLE_TAGS and tag not in ("body", "html")
        stack.push(tag, dropped, article, boxes)
        if tag in DROPPED or hidden:
            dropped = True
        elif (furniture or tag in BOXES and not (tag == "header" and article)) and len(boxes) < MOST_BOXES:  # an article's own header has its title
            boxes, made = (*boxes, made), made + 1
            if tag == "form":
                forms.add(made - 1)
        if tag in ARTICLE_TAGS or names & ARTICLE:
            begun = begun if article else len(boxes)
            article = True
    flush()
    return without_boxes(out, forms)


def line_hashes(lines: list[tuple[str, bool]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines], np.uint64)


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of a's lines in a longest common subsequence of a and b (the earliest in a). Common starts and ends are taken
    off first; the rest is solved over the lines that occur in both. Of the table of lengths only every so many-th row is
    kept, and the rows between are worked out again where the way goes through: memory grows with the root of its size."""
    keep = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lo = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + lo :][::-1] != b[len(b) - n + lo :][::-1])
    hi = int(differ[0]) if len(differ) else n - lo
    keep[:lo] = True
    if hi:
        keep[-hi:] = True
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    i, j = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    if not len(i):
        return keep
    x, y = x[i], y[j]

    def above(row: np.ndarray, line: np.uint64) -> np.ndarray:
        """Lengths for the suffixes of y with one more line of x before."""
        best = np.where(y == line, row[1:] + 1, row[:-1])
        return np.r_[np.maximum.accumulate(best[::-1])[::-1], np.int32(0)]

    step = math.isqrt(len(x)) + 1
    row, kept = np.zeros(len(y) + 1, np.int32), {}
    for r in range(len(x), -1, -1):
        if r < len(x):
            row = above(row, x[r])
        if r % step == 0 or r == len(x):
            kept[r] = row
    r = c = 0
    rows: dict[int, np.ndarray] = {}
    while r < len(x) and c < len(y):
        if r + 1 not in rows:
            end = min(len(x), (r // step + 1) * step)
            rows = {end: kept[end]}
            for k in range(end - 1, r - 1, -1):
                rows[k] = above(rows[k + 1], x[k])
        if x[r] == y[c]:
            keep[lo + i[r]] = True
            r, c = r + 1, c + 1
        elif rows[r + 1][c] >= rows[r][c + 1]:
            r += 1
        else:
            c += 1
    return keep


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (lower case, without user, port and leading www.) and path with query, without fragment. Null: empty."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", (url or "").split("#")[0])
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return host.removeprefix("www."), path


#: Pages and bytes of line hashes of one chunk of the sorted pages.
CHUNK_PAGES, CHUNK_BYTES = 20_000, 1 << 24
#: A page in a chunk: host, hash of its main part, line hashes, article flags, row.
Page = tuple[str, int, bytes, bytes, int]


def last_runs(pages: list[Page], n: int = 3) -> list[Page]:
    """The last page of each of the last n runs of copies (pages of one host with equal main parts that follow one another)
    of the last host, in order."""
    out: list[Page] = []
    for p in reversed(pages):
        if out and p[0] != out[-1][0]:
            break
        if not out or p[1] != out[-1][1]:
            out.append(p)
            if len(out) == n:
                break
    return out[::-1]


def first_runs(pages: list[Page], n: int = 3) -> list[Page]:
    return last_runs(pages[::-1], n)[::-1]


def neighbours(before: list[Page], pages: list[Page], after: list[Page]) -> Iterator[tuple[Page, list[Page], list[Page]]]:
    """Each page with the pages of its host that stand beside its run of copies (two, or one at the host's ends), and with
    the two that decide inside an article: the same, or at the host's ends the next one further on; none if the host has
    no two."""
    everything = before + pages + after
    starts = [i for i, p in enumerate(everything) if not i or p[:2] != everything[i - 1][:2]]
    ends = [*starts[1:], len(everything)]
    host = lambda r: everything[starts[r]][0] if 0 <= r < len(starts) else None
    for r, (a, z) in enumerate(zip(starts, ends, strict=True)):
        left, right = ([everything[ends[k] - 1] if k < r else everything[starts[k]] for k in ks if host(k) == host(r)] for ks in ((r - 1, r - 2), (r + 1, r + 2)))
        two = (left[:1] + right[:1]) if left and right else (left or right)
        for i in range(max(a, len(before)), min(z, len(before) + len(pages))):
            yield everything[i], left[:1] + right[:1], two if len(two) == 2 else []


def template_lines(own: np.ndarray, article: np.ndarray, beside: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Flags of the lines to delete. Lines that the page shares with a page beside it go. Inside the page's own article
    element a line goes if it is shared with both pages of `two`: what one alone shares is a quotation."""
    gone, both = np.zeros(len(own), bool), np.full(len(own), len(two) == 2)
    shared = {id(o): common_lines(own, o) for o in (*beside, *two)}
    for o in beside:
        gone |= shared[id(o)]
    for o in two:
        both &= shared[id(o)]
    return np.where(article, both, gone)


def main_text(lines: list[tuple[str, bool]], gone: np.ndarray) -> str:
    """The lines left, joined by one space; only those of article elements where these hold at least half of the
    characters left, so that a small box named like an article does not hide the text."""
    left = [x for i, x in enumerate(lines) if not (i < len(gone) and gone[i])]
    inside = sum(len(t) for t, a in left if a)
    main = inside and inside * 2 >= sum(len(t) for t, _ in left)
    return " ".join(t for t, a in left if a or not main)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages with text: the lines that differencing leaves, in page order, joined by one space. Where article elements hold
    at least half of what is left, only their lines are main text; else all lines left.

    Pages are sorted by (host, path) over the whole cluster, so a host of any size is dealt over many tasks; line hashes
    alone take part in this. Pages that follow one another with equal main parts (article lines, or all lines where there is
    no article element) are copies: each is compared with the nearest other pages of its host on both sides. Only pages that lose lines are
    shuffled with their html. Null url: host and path are empty; null or empty html: empty text. Repeated rows and equal
    urls: compared like others, each row has its own text. Empty table: empty result. A column text is replaced; all others
    stay, whatever their names."""
    row_, gone_ = free_name(pages, "__row"), free_name(pages, "__gone")
    own = pages.drop("text").withColumn(row_, F.xxhash64(F.col(url), F.col(html)))

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [blocks(x) for x in b["html"]]
            parts, hashes, article = [url_parts(x) for x in b["url"]], [line_hashes(g) for g in got], [np.array([a for _, a in g], bool) for g in got]
            main = [int(np.uint64(xxhash.xxh3_64_intdigest((h[a] if a.any() else h).tobytes())).view(np.int64)) for h, a in zip(hashes, article, strict=True)]
            yield pd.DataFrame({"row": b["row"], "host": [p[0] for p in parts], "path": [p[1] for p in parts], "main": main, "lines": [h.tobytes() for h in hashes], "article": [a.tobytes() for a in article]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "no": [no], "ends": [pickle.dumps((first_runs(held), last_runs(held)))], "body": [pickle.dumps(held)]})

        for b in batches:
            for p in zip(b["host"], b["main"].tolist(), b["lines"], b["article"], b["row"].tolist(), strict=True):
                held.append(p)
                size += len(p[2])
                if len(held) >= CHUNK_PAGES or size >= CHUNK_BYTES:
                    yield out()
                    no, held, size = no + 1, [], 0
        if held:
            yield out()

    # a page without lines tells nothing about its neighbours
    signed = own.select(F.col(row_).alias("row"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(signatures, "row long, host string, path string, main long, lines binary, article binary").where("length(lines) > 0")
    ordered = materialise(signed.dropDuplicates(["row"]).repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row").select("host", "main", "lines", "article", "row").mapInPandas(chunks, "part int, no int, ends binary, body binary"), "pages-sorted")
    # what stands before and after each chunk: at most three pages a side
    ends = {(r["part"], r["no"]): pickle.loads(r["ends"]) for r in ordered.select("part", "no", "ends").collect()}
    before, after, held = {}, {}, []
    for k in sorted(ends):
        before[k], held = held, last_runs(held + ends[k][1])
    held = []
    for k in sorted(ends, reverse=True):
        after[k], held = held, first_runs(ends[k][0] + held)

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in zip(b["part"].tolist(), b["no"].tolist(), b["body"], strict=True):
                rows, flags, seen = [], [], {}
                for page, beside, two in neighbours(before[k[:2]], pickle.loads(k[2]), after[k[:2]]):
                    # only pages near by are looked at again
                    seen = {id(p): seen[id(p)] if id(p) in seen else np.frombuffer(p[2], np.uint64) for p in (*beside, *two)}
                    gone = template_lines(np.frombuffer(page[2], np.uint64), np.frombuffer(page[3], bool), [seen[id(p)] for p in beside], [seen[id(p)] for p in two])
                    if gone.any():
                        rows.append(page[4])
                        flags.append(np.packbits(gone).tobytes())
                yield pd.DataFrame({"row": rows, "gone": flags})

    gone = materialise(ordered.select("part", "no", "body").mapInPandas(differ, "row long, gone binary"), "pages-gone").select(F.col("row").alias(row_), F.col("gone").alias(gone_))

    @F.pandas_udf("string")
    def keep(pages_: pd.Series, flags: pd.Series) -> pd.Series:
        return pd.Series([main_text(blocks(x), np.unpackbits(np.frombuffer(f or b"", np.uint8))) for x, f in zip(pages_, flags, strict=True)])

    hits, rest = by_listing(own, gone, row_)
    out = rest.withColumn(gone_, F.lit(None).cast("binary"))
    if hits is not None:
        out = out.unionByName(hits.join(gone, row_, "left"))
    return out.withColumn("text", keep(F.col(html), F.col(gone_))).drop(row_, gone_)


def op5(spark, sf_dir):
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_page_text": op5}
