"""Main text of web pages by tree scoring.

One pass over the markup builds the element tree (with the end tags that authors
leave out) and the page's blocks of text.  Page furniture is told by element,
role and the words of class and id, and cut.  Each remaining block then passes
points for its length and its commas to the elements above it, all to the
nearest container, half to the next and ever less to those above, discounted by
the share of its text that is links; a container's points are discounted by its
own link share again.  The best container is the article: the ``article`` or
``main`` element around it where there is one, with sibling articles that score
a fifth as much, or else the container with those of its siblings that score or
read like prose or are headings.  Lists of links inside are menus, and cut.

A page is judged alone, in time and memory in proportion to its markup (some
300 bytes a tag), by one task; pages are independent rows, so a lost executor
costs its pages.

Defined results: a null or empty page, and one without any text, gives the empty
text and 0; repeated rows, ties and null keys need no rule (of containers with
equal points the first is taken); an empty table gives no rows; other columns
stay, and the outputs get leading underscores where their names are taken.
White space is what Unicode calls so; one ``<br>`` is white space, two in a row
end a block; table cells and list items are blocks.  Markup that never ends is
read to the page's end, as browsers do.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .shared import fresh

#: Bytes of pages whose results are sent together.
CHUNK = 2 << 20

# Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, with the pattern of their end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noembed noframes noscript template xmp".split()}
#: Start tags that leave an open paragraph open.
KEEPS_P = frozenset("body caption head html legend tbody td tfoot th thead tr".split())
#: An open element that a start tag ends, and what stands between them if it doesn't.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "a": ({"a"}, BLOCK),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("caption html table td th button object".split())

#: Elements that are never part of an article.
FURNITURE = frozenset("aside button canvas datalist dialog footer form head label legend menu meter nav progress search select svg textarea title".split())
ROLES = frozenset("alert alertdialog complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
#: Words of class and id that mark menus, footers, side columns, notices, adverts, forms and comments.
WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising adslot aside banner breadcrumb breadcrumbs colophon comment
    commentform commentlist comments consent cookie cookies copyright discussion disqus foot footer gdpr hidden login menu menubar modal nav
    navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recommended related
    replies reply respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription
    toast toolbar trending widget widgets""".split()
)
STEMS = ("advert", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
ENDINGS = ("footer", "menu", "nav", "sidebar")
COMMENTS = frozenset("comment commentform commentlist comments discussion disqus replies reply respond".split())
HEADERS = frozenset("header masthead topbar".split())
#: A class like "has-sidebar" speaks of another element.
ABOUT = frozenset("has no non with without".split())
GOOD = frozenset("article blog body content entry main page post story text".split())

PARAGRAPH = frozenset("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
PROSE = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
LISTS = frozenset("div dl ol p section table ul".split())
COMMAS = re.compile("[,،、，﹐﹑]")

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:\s+|[/=]|[^\s/>=]+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?)*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+))?)?""")
NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "href"))


def attributes(source: str) -> dict[str, str]:
    """The attributes that matter here; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name in READ:
            out.setdefault(name, markup.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Page:
    """Elements (tag, parent, nearest block element, attributes) in page order and
    pieces of text (element, number of the block, text, whether in a link)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.block, self.attrs = ["#"], [-1], [0], [{}]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.stack, self.open, self.number, self.breaks = [0], {}, 0, 0
        self._read(source)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.block.append(at if tag in BLOCK else self.block[self.stack[-1]])
        self.attrs.append(attrs)
        if tag not in VOID:
            self.stack.append(at)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        for at in self.stack[depth:]:
            self.open[self.tag[at]] -= 1
        del self.stack[depth:]

    def _find(self, tags, stop) -> int:
        """Depth of the nearest open element of ``tags`` inside any of ``stop``, or 0."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in stop:
                break
        return 0

    def _end(self, tags, stop) -> None:
        if any(self.open.get(t) for t in tags) and (depth := self._find(tags, stop)):
            self._pop_to(depth)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCK:
            self.number += 1
            self.breaks = 0
            if tag != "head":
                self._end({"head"}, ())
            if tag not in KEEPS_P:
                self._end({"p"}, P_SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "br":
            self.breaks += 1
            self.number += self.breaks == 2
            self._text(" ")
        else:
            self._push(tag, attrs)

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self.number += 1
            self.breaks = 0
            self._end({tag}, ())
        elif tag == "br":
            self._start("br", {})
        else:
            self._end({tag}, BLOCK)

    def _text(self, raw: str) -> None:
        if raw and not raw.isspace():
            self.breaks = 0
            if self.open.get("head"):
                self._end({"head"}, ())
        if raw:
            self.pieces.append((self.stack[-1], self.number, markup.unescape(raw) if "&" in raw else raw, bool(self.open.get("a"))))

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                return
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                elif tag in RAW:
                    close = RAW[tag].search(source, at)
                    at = close.start() if close else end
                else:
                    self._start(tag, attributes(m[3]) if m[3] else {})


def words_of(attrs: dict[str, str]) -> set[str]:
    """The words of class and id; none of a name that speaks of another element."""
    out: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in NAME.findall(name)}
        if not words & ABOUT:
            out |= words
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _furniture(page: Page) -> list[bool]:
    """Which elements are cut, by themselves or with one above them."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    words = [words_of(a) if a else set() for a in page.attrs]
    length, texts, last = [0] * n, [0] * n, -1
    for at, number, text, link in page.pieces:
        if not link and (size := len(text.strip())):
            length[page.block[at]] += size
            texts[page.block[at]] += number != last
            last = number
    holds = [t in ("h1", "main") for t in tag]
    articles = [int(t == "article" and not words[i] & COMMENTS) for i, t in enumerate(tag)]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        holds[up] |= holds[i]
        articles[up] += articles[i]
        length[up] += length[i]
        texts[up] += texts[i]
    unmarked = not articles[0] and "main" not in tag
    cut, inside = [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        inside[i] = inside[up] or tag[i] in ("article", "main")
        if cut[up]:
            cut[i] = True
            continue
        if tag[i] in ("html", "body", "main"):
            continue
        if not (attrs := page.attrs[i]) and tag[i] not in FURNITURE and tag[i] != "header":
            continue
        role = attrs.get("role", "").lower()
        marked = words[i] & WORDS or {w for w in words[i] if w.startswith(STEMS) or w.endswith(ENDINGS)}
        # a wrapper of the page, not furniture, however it is called
        wraps = holds[i] or (articles[i] > 0 and articles[i] == articles[0])
        if _hidden(attrs) or (tag[i] in FURNITURE and not (tag[i] == "form" and wraps)) or role in ROLES:
            cut[i] = True
        elif tag[i] == "header" or role == "banner" or words[i] & HEADERS or any(w.endswith("header") for w in words[i]):
            cut[i] = not inside[up] and not (articles[i] and wraps) and not (words[i] & GOOD - {"page", "body", "main"})
        elif marked & COMMENTS:
            cut[i] = not holds[i]
        elif marked:
            cut[i] = not wraps and not (unmarked and texts[i] > 2 and 2 * length[i] > length[0])
    return cut


def main_blocks(source: str) -> list[str]:
    """The blocks of the page's article, in page order."""
    page = Page(source)
    tag, parent, block, n = page.tag, page.parent, page.block, len(page.tag)
    cut = _furniture(page)
    joined: dict[int, tuple[int, list[str], list[str]]] = {}
    for at, number, text, link in page.pieces:
        if not cut[at]:
            _, texts, links = joined.setdefault(number, (block[at], [], []))
            texts.append(text)
            if link:
                links.append(text)
    blocks = []  # (owner, text, letters in links)
    for owner, texts, links in joined.values():
        if text := " ".join("".join(texts).split()):
            blocks.append((owner, text, min(len(text), len(" ".join("".join(links).split())))))
    if not blocks:
        return []

    points, letters, linked = [0.0] * n, [0] * n, [0] * n
    for owner, text, link in blocks:
        letters[owner] += len(text)
        linked[owner] += link
        if len(text) < 25:
            continue
        gain = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - link / len(text))
        at, level = (block[parent[owner]] if tag[owner] in PARAGRAPH and owner else owner), 0
        while level < 5:
            points[at] += gain / (1, 2, 6, 9, 12)[level]
            if at == 0:
                break
            at, level = block[parent[at]], level + 1
    anchors, titled = [int(t == "a") for t in tag], [t == "h1" and not cut[i] for i, t in enumerate(tag)]
    for i in range(n - 1, 0, -1):
        letters[parent[i]] += letters[i]
        linked[parent[i]] += linked[i]
        anchors[parent[i]] += anchors[i]
        titled[parent[i]] |= titled[i]
    share = [linked[i] / letters[i] if letters[i] else 0.0 for i in range(n)]
    for i in range(n):
        if tag[i] in ("article", "main") or (points[i] > 0 and words_of(page.attrs[i]) & GOOD):
            points[i] += 25 * (letters[i] > linked[i])
        points[i] *= 1 - share[i]
    best = max(range(n), key=lambda i: points[i])  # the whole page if it has short blocks only
    if letters[best] == linked[best]:
        return []

    region = next((i for kind in ("article", "main") for i in _line(best, parent) if tag[i] == kind), None)
    kept = {best if region is None else region}
    least = max(10.0, points[best] / 5)
    top = parent[next(iter(kept))]
    loose = region is None and best != 0
    for i in range(1, n):
        if parent[i] != top or cut[i] or not letters[i] or i in kept:
            continue
        if region is not None:
            if tag[region] == tag[i] == "article" and points[i] >= least:
                kept.add(i)
        elif loose and block[i] == i:
            alike = tag[i] == tag[best] and page.attrs[i].get("class") and page.attrs[i].get("class") == page.attrs[best].get("class")
            prose = tag[i] in PROSE or titled[i] or alike
            if points[i] >= least or (prose and share[i] < 0.25):
                kept.add(i)

    inside, menu = [False] * n, [False] * n
    for i in range(n):
        up = parent[i]
        inside[i] = i in kept or (i > 0 and inside[up])
        menu[i] = i > 0 and (menu[up] or (i not in kept and tag[i] in LISTS and share[i] > 0.6 and anchors[i] > 2))
    stray = block[top] if loose and top > 0 and tag[top] not in ("html", "body") else -1
    return [text for owner, text, _ in blocks if (inside[owner] and not menu[owner]) or (owner == stray and len(text) >= 25)]


def _line(at: int, parent: list[int]):
    while at >= 0:
        yield at
        at = parent[at]


def main_text(source: str | None) -> str:
    """The article's blocks, joined by two line ends."""
    return "\n\n".join(main_blocks(source)) if source else ""


def extract(df: DataFrame, html: str = "html", keep_html: bool = True) -> DataFrame:
    """Adds ``text`` and ``n_chars``, its code points."""
    names = [fresh(df, "text"), fresh(df, "n_chars")]
    kinds = [T.StringType(), T.LongType()]
    schema = T.StructType([*(f for f in df.schema.fields if keep_html or f.name != html), *(T.StructField(a, b) for a, b in zip(names, kinds, strict=True))])
    at, columns = df.columns.index(html), schema.names

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at), CHUNK):
                raw = data.tobytes()
                texts = [main_text(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(hi - lo)]
                rows = [c for i, c in enumerate(batch.slice(lo, hi - lo).columns) if keep_html or i != at]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=columns)

    return df.mapInArrow(K.task(run), schema)
