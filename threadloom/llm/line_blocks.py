"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's length is what is not link text (nothing where links
outweigh the rest); lines of menus, headers, footers, sidebars, notices, adverts and forms have no length at all, which
their element tells (nav, footer, form …) or a class, id or role that names such a part and nothing else. Lengths are
summed over windows of ``WINDOW`` lines. Text is kept from a surge (the first window over the threshold, or over the
page's greatest sum if none gets there) to the dive (the last such window before a line without length); a run that
never surges goes. Within a window at a run's edge, lines too short for a share of the threshold go too. Lines inside an
article are certain: they all count, and what has no length among them only falls out itself. If a page has no article
and nothing surges but what classes mark, those marks are taken back.

Null and empty pages give the empty text. Repeated pages give equal texts. An empty table gives no rows. Broken markup:
optional end tags are implied; an element that would stand aside but that neither its own end tag nor its parent's
closes is read like any other; a script or style without an end takes the rest of the page; once quotes leave a tag
without an end, they no longer hide a ``>``. References are decoded run by run. Pages of any length and depth are
scanned once, forward; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slices

WINDOW = 3
SURGE_CHARS = 86
MAX_LINK_SHARE = 0.5

# Element names by their part in a page, and words in class, id or role that mark what is no article.
RAW = frozenset("script style noscript template textarea iframe object svg canvas title head".split())
CODE = frozenset(("script", "style"))
ASIDE = frozenset("nav footer aside form button select menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th option".split())
# Optional end tags: an element -> (open elements that its start closes, elements that the search does not pass).
_CELLS, _ITEMS = frozenset(("td", "th")), BLOCKS - frozenset("address div p".split())
_CLOSES_P = (frozenset(("p",)), frozenset("button caption table td th".split()))
_TABLE = frozenset(("table",))
IMPLIED = {name: _CLOSES_P for name in BLOCKS - frozenset("body dd dt figcaption head html li summary tbody tfoot thead tr".split()) | {"hr"}} | {
    "li": (frozenset(("li",)), _ITEMS - {"li"}), "dt": (frozenset(("dt", "dd")), _ITEMS - {"dt", "dd"}), "dd": (frozenset(("dt", "dd")), _ITEMS - {"dt", "dd"}),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELLS, _TABLE | {"tr"}), "th": (_CELLS, _TABLE | {"tr"}), "tr": (_CELLS | {"tr"}, _TABLE),
} | dict.fromkeys(("tbody", "thead", "tfoot"), (_CELLS | {"tr", "tbody", "thead", "tfoot"}, _TABLE))
WHOLE = frozenset("html body main article".split())
ENDS_ALONE = frozenset("p li dt dd td th tr tbody thead tfoot option optgroup".split())
_TABLE_PARTS = _CELLS | frozenset("table caption tbody tfoot thead tr".split())
MARKED = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion comment comments replies disqus sidebar widget widgets nav navbar navigation navi "
    "menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login related recommend recommended recommendations sharing share social pagination pager masthead topbar contentinfo complementary search".split()
)
#: Parts of a name that say nothing by themselves: with one of ``MARKED`` they name such a part of a page.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content danger desktop error field first fixed foot global group head header holder icon icons info inner input item items js label last left link links list "
    "main message mobile module more outer page panel post posts primary region right row secondary section side site slot small space sticky success text thread title toggle tool tools top ui unit warning wrap wrapper zone".split()
)
_ATTRS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_STOP = re.compile(r"""["'>]""")
_SPACE = re.compile(r"\s+")


def _is_aside(name: str, attrs: str, in_article: bool) -> bool:
    if name in ASIDE or name == "header" and not in_article:
        return True
    if name in ("body", "html", "article", "main") or not attrs:
        return False
    return "hidden" in attrs.lower().split() or any(_names_part(token) for a, b, c in _ATTRS.findall(attrs) for token in (a or b or c).lower().split())


def _names_part(token: str) -> bool:
    """``nav-item`` and ``ad_box2`` name a part of a page that is no article, ``notice-of-motion`` does not."""
    parts = [p for p in (re.sub(r"\d+$", "", x) for x in re.split(r"[-_]+", token)) if p]
    return any(p in MARKED for p in parts) and all(p in MARKED or p in NEUTRAL for p in parts)


class _Open:
    """The open elements: their names in order, and for each name where it stands."""

    def __init__(self):
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}

    def has(self, name: str) -> bool:
        return bool(self.at.get(name))

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)

    def cut(self, names: frozenset, walls: frozenset, every: bool = False) -> None:
        """Close the innermost open element of ``names``, or the outermost one, and all inside it; not past ``walls``."""
        places = [self.at[n] for n in names if self.at.get(n)]
        if not places:
            return
        wall = max((self.at[w][-1] for w in walls if self.at.get(w)), default=-1)
        above = [p[bisect_right(p, wall)] if every else p[-1] for p in places if p[-1] > wall]
        if above:
            first = min(above) if every else max(above)
            while len(self.stack) > first:
                self.at[self.stack.pop()].pop()

    def follow(self, name: str, closing: bool, opens: bool) -> None:
        """Apply a tag, optional end tags included."""
        if closing:
            walls = _TABLE if name in _TABLE_PARTS else _CELLS | _TABLE if name in BLOCKS or name in SPACED else BLOCKS | _CELLS
            self.cut(frozenset((name,)), walls - {name})
            return
        if name in IMPLIED:
            if name in ("li", "dt", "dd"):
                self.cut(*_CLOSES_P)
            self.cut(*IMPLIED[name], every=name in ("optgroup", "tr", "tbody", "thead", "tfoot"))
        if opens:
            self.push(name)


class _Scanner:
    """Runs of text and tags of a page, in one pass forward."""

    def __init__(self, page: str):
        self.page, self.quotes, self.ends = page, True, {}

    def closed_after(self, name: str, at: int) -> int:
        """Where the next end tag of that name begins, -1 if there is none."""
        known = self.ends.get(name, -2)
        if known != -1 and known < at:
            found = re.compile(rf"</{re.escape(name)}(?![a-zA-Z0-9:-])", re.I).search(self.page, at)
            known = self.ends[name] = found.start() if found else -1
        return known

    def _tag_end(self, at: int) -> int:
        """Position of the ``>`` that ends a tag whose name ends at ``at``, -1 if there is none."""
        start = at
        while self.quotes:
            stop = _TAG_STOP.search(self.page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            at = self.page.find(stop[0], stop.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", start)

    def parts(self):
        """(text before, name, closing?, attributes, position after) of each tag; a last one without a name."""
        page, at, done = self.page, 0, len(self.page)
        begin = 0  # where the text that is not given out yet begins
        while True:
            at = page.find("<", at)
            if at < 0:
                yield page[begin:], "", False, "", done
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                yield page[begin:at], "", False, "", at
                begin = at = done if end < 0 else end + 3
                continue
            name = _NAME.match(page, at + 1)
            if name is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            end = self._tag_end(name.end()) if name else page.find(">", at)
            if end < 0:
                yield page[begin:], "", False, "", done
                return
            before, begin = page[begin:at], end + 1
            at = begin
            if name is None:
                yield before, "", False, "", at
                continue
            closing = name[0][0] == "/"
            tag = name[0].lstrip("/").lower()
            if tag in RAW and not closing and page[end - 1] != "/":
                until = self.closed_after(tag, begin)
                if until >= 0 or tag in CODE:
                    yield before, "", False, "", at
                    after = page.find(">", until) if until >= 0 else -1
                    begin = at = done if after < 0 else after + 1
                    continue
            yield before, tag, closing, page[name.end() : end], at


@dataclass(frozen=True)
class Line:
    """A block's text. ``linked``: length of its link text; ``inside``: in an article; ``aside``: its element tells that it is
    no article (``SURE``) or a class does (``TOLD``), else 0."""

    text: str
    linked: int
    inside: bool
    aside: int


TOLD, SURE = 1, 2


def page_lines(page: str) -> list[Line]:
    """The lines of a page in order; what stands aside inside a paragraph is a line before it."""
    lines: list[Line] = []
    text, linked, inside = [], 0, False
    side: list[str] = []
    skip, kind, anchor = 0, 0, 0  # skip: how many elements are open while one that stands aside is
    open_, scanner = _Open(), _Scanner(page)
    stack = open_.stack

    def close():
        nonlocal text, linked, inside
        if line := _SPACE.sub(" ", "".join(text)).strip():
            lines.append(Line(line, linked, inside, 0))
        text, linked, inside = [], 0, False

    def close_side():
        nonlocal side
        if line := _SPACE.sub(" ", "".join(side)).strip():
            lines.append(Line(line, 0, False, kind))
        side = []

    def add(run: str):
        nonlocal linked, inside
        if not run:
            return
        run = html.unescape(run) if "&" in run else run
        if skip:
            side.append(run)
            return
        text.append(run)
        if bare := len(run.strip()):
            inside = inside or open_.has("article") or open_.has("main")
            linked += bare if anchor else 0

    for before, name, closing, attrs, at in scanner.parts():
        add(before)
        if not name:
            continue
        opens = not closing and name not in VOID and not attrs.endswith("/")
        aside = stack[skip - 1] if skip else ""
        open_.follow(name, closing, opens)
        if skip:
            if name in BLOCKS:
                close_side()
            if len(stack) >= skip and not (opens and len(stack) == skip):
                continue
            close_side()
            ended, skip = skip, 0
            if closing and name == aside and len(stack) == ended - 1:
                continue
        if name in BLOCKS:
            close()
        elif name in SPACED:
            add(" ")
        article = open_.has("article") or open_.has("main")
        if opens and _is_aside(name, attrs, article) and (name in ENDS_ALONE or any(n not in WHOLE and scanner.closed_after(n, at) >= 0 for n in stack[-1:-3:-1])):
            skip, kind = len(stack), SURE if name in ASIDE or name == "header" else TOLD
        elif name == "a":
            anchor = 1 if opens else 0
    close_side()
    close()
    return lines


def _lengths(lines: list[Line], told: bool) -> list[int]:
    """What each line counts; ``told``: whether lines that only a class marks count too."""
    out = []
    for x in lines:
        free = len(x.text) - x.linked
        if x.aside == SURE or x.aside == TOLD and not told:
            out.append(0)
        else:
            out.append(len(x.text) if x.inside else 0 if x.linked > MAX_LINK_SHARE * len(x.text) else free)
    return out


def surges(lengths: list[int]) -> tuple[list[int], int]:
    """(sums of the windows that begin at each line, threshold of this page)."""
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    return sums, min(SURGE_CHARS, max(sums, default=0))


def kept_lines(lines: list[Line]) -> list[int]:
    """Which lines lie between surge and dive."""
    lengths = _lengths(lines, False)
    if not any(x.inside and n for x, n in zip(lines, lengths)) and surges(lengths)[1] < SURGE_CHARS <= surges(told := _lengths(lines, True))[1]:
        lengths = told
    sums, surge = surges(lengths)
    least = surge / WINDOW
    kept, at = [], 0
    while at < len(lines):
        if not lengths[at]:
            at += 1
            continue
        # A run goes on to the dive; inside an article lines without length do not end it.
        end, article = at, lines[at].inside
        while end < len(lines) and (lengths[end] or article and any(x.inside for x in lines[end + 1 : end + 2])):
            article = lines[end].inside or article and not lengths[end]
            end += 1
        run = [i for i in range(at, end) if lengths[i]]
        high = [i for i in run if sums[i] >= surge]
        sure = [i for i in run if lines[i].inside]
        if high or sure:
            first = next((i for i in run if high and i >= high[0] and lengths[i] >= least), len(lines))
            last = next((i for i in reversed(run) if high and i < high[-1] + WINDOW and lengths[i] >= least), -1)
            kept += [i for i in run if min([first, *sure[:1]]) <= i <= max([last, *sure[-1:]])]
        at = end
    return kept


def main_text(page: str | None) -> str:
    """The lines between surge and dive, joined by line feeds."""
    lines = page_lines(page or "")
    return "\n".join(lines[i].text for i in kept_lines(lines))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row, in input partitions: no shuffle."""
    types = dict(pages.dtypes)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
