"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements (optional end tags, void and raw-text elements, comments and broken nesting handled)
and a list of text blocks in page order. Elements that never hold the article (navigation, forms, scripts, footers ...)
and elements whose role, class or id words say so are left out. Every block passes points for its length and its commas
to its parent, half of them to the parent above and a third of what is left to each one further up; an element's points
are discounted by the share of its text that is in links. The best element, or the article or main element around it, is
the container; its siblings are kept if they score well too or, beside a container that is neither, hold paragraphs or
headings of little link text. Parsing and scoring take time in proportion to the page, whatever its nesting.

Defined cases: null and empty pages, and pages without text, give an empty text. Unclosed elements end with their
parent, unclosed form controls and templates are empty; an unclosed comment or script reaches to the end; a quote that
never ends is a part of its tag up to the next >. White space is what Unicode says, no-break spaces included.
Rows are independent, so repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Element names (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes noembed".split())
#: Parts that never hold the article, and are empty where their end is missing.
CONTROLS = frozenset("button select datalist noscript template".split())
SKIP = frozenset("nav footer aside form menu dialog head fieldset".split()) | CONTROLS | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that the start of another one ends, up to the nearest of the bounds (fixed values).
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
#: Words of classes, ids and roles of parts that are not the article (fixed values).
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion promoted teaser nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside rail footer contentinfo masthead topbar cookie cookies consent gdpr privacy notice notices alert share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login register popup modal overlay dialog widget widgets pagination pager toolbar complementary search paywall outbrain taboola hidden".split()
)
#: Elements whose points go to what holds them (fixed values).
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre td blockquote dd dt figcaption".split())
#: Characters from which text outside of paragraphs, beside the container, is kept.
LOOSE = 80
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions feedback".split())
HEADS = frozenset("header banner masthead".split())
_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+))?)*+)(>|\Z)?""")
_DIGITS = re.compile(r"&#(?:0*[1-9]\d{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Page:
    """The tree: lists by element number; blocks as [element, text pieces, characters in links]."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.blocks: list[list] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        tag, stack, at, n, links, open_block = self.tag, [0], 0, len(s), 0, None
        held: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        tops: list[int] = []  # where in the stack the open blocks and left-out parts are
        ended: set[int] = set()  # links that ended while blocks inside them stay open
        low = s.lower()
        last_end = {name: low.rfind("</" + name) for name in CONTROLS}

        def cut(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                e = stack.pop()
                if e in ended:
                    continue
                held[tag[e]].pop()
                links -= tag[e] == "a"
                if tops and tops[-1] == len(stack):
                    tops.pop()

        def end(name: str) -> None:
            """An end tag; one of an inline element leaves the blocks inside it open."""
            nonlocal links
            if at_ := held.get(name):
                if name in BLOCK or name in SKIP or not tops or tops[-1] < at_[-1]:
                    cut(at_[-1])
                else:
                    ended.add(stack[at_.pop()])
                    links -= name == "a"

        def text(raw: str) -> None:
            nonlocal open_block
            if raw:
                if open_block is None:
                    if raw.isspace():
                        return
                    open_block = [stack[tops[-1]] if tops else 0, [], 0]
                    self.blocks.append(open_block)
                plain = html.unescape(_DIGITS.sub("\ufffd", raw)) if "&" in raw else raw
                open_block[1].append(plain)
                if links:
                    open_block[2] += len("".join(plain.split()))

        while at < n:
            m = _TOKEN.search(s, at)
            if not m:
                text(s[at:])
                break
            text(s[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                close = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">"
                if m[0] == "<!--" and s.startswith(">", at):
                    at += 1
                    continue
                stop = s.find(close, at)
                at = n if stop < 0 else stop + len(close)
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK or name in SKIP:
                    open_block = None
                end(name)
                continue
            if name in RAW:
                open_block = None
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])").search(low, at) if len(low) == n else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(s, at)
                stop = s.find(">", stop.end()) if stop else -1
                at = n if stop < 0 else stop + 1
                continue
            if name == "br" or name == "wbr":
                text(" " if name == "br" else "")
                continue
            if name in VOID:
                if name == "hr":
                    open_block = None
                continue
            if name in CONTROLS and last_end[name] < at:
                continue
            if name == "a":
                end("a")
            if name in BLOCK:
                open_block = None
                to = len(stack)
                if tops and tag[stack[tops[-1]]] == "p":
                    to = tops[-1]
                if name in ENDS:
                    over, bound = (max((held[x][-1] for x in names if held.get(x)), default=-1) for names in ENDS[name])
                    if over > bound:
                        to = min(to, over)
                cut(to)
            elif name in CONTROLS:
                open_block = None
            tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(m[3])
            if not (m[3].endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "span", "em", "strong")):
                held.setdefault(name, []).append(len(stack))
                if name in BLOCK or name in SKIP:
                    tops.append(len(stack))
                links += name == "a"
                stack.append(len(tag) - 1)


def _words(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element says it is hidden."""
    found, hidden = set(), False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), a or b or c
        if k in ("class", "id", "role"):
            found.update(w.lower() for w in _WORD.findall(v))
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v):
            hidden = True
    return found, hidden


def main_text(source: str | None) -> str:
    """The article's blocks, joined by two line feeds."""
    if not source:
        return ""
    page = _Page(source)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    blocks = []
    for owner, parts, links in page.blocks:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((owner, text, links))
    if not blocks:
        return ""
    # what each element holds: characters, and whether an article's marks are inside
    chars, linked, marks = [0] * n, [0] * n, [False] * n
    for owner, text, links in blocks:
        chars[owner] += len(text)
        linked[owner] += links
    links_in = [0] * n
    for e in range(n - 1, 0, -1):
        p = parent[e]
        chars[p] += chars[e]
        linked[p] += linked[e]
        links_in[p] += links_in[e] + (tag[e] == "a")
        marks[p] = marks[p] or marks[e] or tag[e] in ("article", "main", "h1")
    junk, within = [False] * n, [False] * n
    for e in range(1, n):
        p, t = parent[e], tag[e]
        within[e] = within[p] or t in ("article", "main")
        junk[e] = junk[p] or t in SKIP and not (t == "form" and marks[e]) or t == "header" and not within[e]
        if not junk[e] and page.attrs[e] and t not in ("html", "body", "main"):
            words, hidden = _words(page.attrs[e])
            if words & COMMENTS:
                junk[e] = t not in ("article",) or not marks[e] or bool(words & {"comment", "reply"})
            elif hidden or words & JUNK or "header" in words and not within[e]:
                junk[e] = t not in ("article",) and not (marks[e] and not hidden)
    kept = [b for b in blocks if not junk[b[0]]]
    if not kept:
        return ""
    # points
    points, own, above, prose = [0.0] * n, [0.0] * n, [0.0] * n, [False] * n
    for owner, text, links in kept:
        size = len(text)
        share = (1 + text.count(",") + text.count("،") + text.count("、") + min(size / 100, 3.0 + size / 1000)) * (1 - min(1.0, links / max(1, size)))
        # a paragraph's points go to what holds it
        own[parent[owner] if tag[owner] in PARAGRAPHS else owner] += share
        prose[owner] = prose[owner] or tag[owner] in PARAGRAPHS
    for e in range(n - 1, 0, -1):
        p = parent[e]
        points[e] = own[e] + above[e]
        above[p] += own[e] / 2 + above[e] / 3
        prose[p] = prose[p] or prose[e]
    for e in range(1, n):
        points[e] *= 1 - min(1.0, linked[e] / max(1, chars[e]))
        if tag[e] == "article":
            points[e] = points[e] * 1.5 + 5
        elif tag[e] in ("main", "body", "html") and tag[e] != "main":
            points[e] *= 0.9
        if junk[e]:
            points[e] = 0
    best = max(range(n), key=lambda e: (points[e], -e))
    e = best
    while e > 0:
        if tag[e] in ("article", "main"):
            best = e
            if tag[e] == "article":
                break
        e = parent[e]
    if tag[best] not in ("article", "main"):
        # a heading or most other text beside it, under one parent, belongs to it
        while parent[best] > 0 and tag[parent[best]] not in ("body", "html") and points[parent[best]] >= 0.6 * points[best]:
            best = parent[best]
    inside = [False] * n
    inside[best] = True
    for e in range(best + 1, n):
        inside[e] = inside[parent[e]]
    if parent[best] >= 0:
        beside = {e for e in range(1, n) if parent[e] == parent[best] and e != best and not junk[e]}
        for e in beside:
            density = linked[e] / max(1, chars[e])
            if density < 0.25 and (points[e] >= max(10.0, 0.2 * points[best]) or (prose[e] or chars[e] >= LOOSE) and tag[best] not in ("article", "main")):
                inside[e] = True
        for e in range(1, n):
            inside[e] = inside[e] or inside[parent[e]] and parent[e] in beside
            if inside[e] and parent[e] in beside:
                beside.add(e)
    # lists of links inside the container are menus
    for e in range(1, n):
        if inside[e] and e != best and tag[e] in ("ul", "ol", "dl", "div", "section", "table") and links_in[e] >= 2 and linked[e] > 0.6 * chars[e]:
            junk[e] = True
        junk[e] = junk[e] or junk[parent[e]]
    return "\n\n".join(text for owner, text, _ in kept if inside[owner] and not junk[owner])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
