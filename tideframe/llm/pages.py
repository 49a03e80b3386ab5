"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text at block-level tags. For every root-to-leaf tag path the text
length, punctuation and linked text of its blocks are summed; a path's ratios are smoothed over the
page's block sequence with a Gaussian kernel, fused into one score, and thresholded. The innermost
element that holds nearly all selected text is the article. Inside it a path stays when enough of
its text is not linked; without such an element the selected paths are the result. Blocks are
returned in page order.

Elements that are never text of the page (navigation, scripts, controls, hidden ones, ...) are left
out by their tag. A class, id or role that names something else (an advert, a side bar, comments) is
a penalty on the scores below it and ends a path's claim inside the article; an element that holds
most of the page's article or main text, or its only top heading, is not penalised for its name.

Defined results: null or empty html, or a page without text, gives empty text. Broken markup is
read as far as it goes: unclosed elements end with their parent, stray end tags are ignored, an
unfinished tag or comment at the end of the page is dropped. Rows are independent; other columns
are ignored. Time and memory grow with the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tideframe.llm.common import arrow_map, table

#: Elements whose whole content is not text of the page.
DROPPED = frozenset(
    "head script style noscript template svg math canvas iframe object embed nav footer aside button select option "
    "textarea input label dialog menu audio video".split()
)
#: Elements that stand in a line of text; any other element ends the block before it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
#: Words that, anywhere in a class, id or role, name something other than the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent newsletter subscribe "
    "sidebar navbar navigation breadcrumb breadcrumbs footer masthead pagination popup modal login complementary contentinfo".split()
)
#: Words that do so as the last of a name: "site-notice", but not "notice-of-meeting".
LAST = frozenset(
    "banner notice alert subscription signup nav menu foot related recommended recommendations share sharing social widget "
    "pager search toolbar skip header promotion".split()
)
#: Words of readers' comments; what an element so named holds never clears its name.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the second kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that an implied end of another element does not cross.
SCOPES = frozenset("html body table ul ol dl article section div main aside nav form".split())
#: A block is selected when its smoothed score is at least this part of the page's text-weighted mean.
THRESHOLD = 0.2
#: The article's element holds at least this part of the selected text.
HOLDS = 0.85
KERNEL = (1, 4, 6, 4, 1)
#: Score and weight of a block below an element named as something else are multiplied by this.
PENALTY = 0.002
#: A path inside the article stays when at least this part of its text is not linked.
UNLINKED = 0.4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?…。、，！？¿¡]")


class _Element:
    """An element: its place in the list of elements, its path's number, and what its markup says."""

    __slots__ = ("tag", "up", "no", "path", "depth", "out", "inside", "name")

    def __init__(self, tag: str, up: _Element | None, no: int, path: int, out: bool, name: str) -> None:
        self.tag, self.up, self.no, self.path, self.out, self.name = tag, up, no, path, out, name
        self.depth = up.depth + 1 if up else 0
        self.inside = tag in ("article", "main") or up is not None and up.inside


def _attributes(tag: str, raw: str, inside: bool) -> tuple[str, bool, str]:
    """The element's label in paths, whether it is hidden, and what its names say: "", "other" or "comments"."""
    label, out, name = tag, False, ""
    for m in _NAMED.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out = True
        elif key in ("class", "id", "role"):
            for token in value.split():
                pieces = [x.lower() for x in _PIECE.findall(token)]
                if not COMMENTS.isdisjoint(pieces):
                    name = "comments"
                elif not OTHER.isdisjoint(pieces) or pieces and pieces[-1] in LAST and not (inside and pieces[-1] == "header"):
                    name = name or "other"
            if key == "class" and value.split():
                label = f"{tag}.{value.split()[0]}"
    return label, out, name


def _blocks(html: str) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """All elements in page order; element, text and linked characters of each block that is not left out."""
    blocks: list[tuple[_Element, str, int]] = []
    here = _Element("", None, 0, 0, False, "")
    elements, paths, open_tags = [here], {}, Counter()
    parts: list[str] = []
    link, linked, at = 0, 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            if not here.out and (text := " ".join(unescape("".join(parts)).split())):
                blocks.append((here, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not here.out:
            parts.append(text)
            linked += len(text) if link else 0

    def leave(e: _Element) -> None:
        """Close what is open below e."""
        nonlocal here
        while here is not e:
            open_tags[here.tag] -= 1
            here = here.up

    find, n = _TOKEN.search, len(html)
    while m := find(html, at):
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                link = max(0, link - 1) if closing else 1
            elif tag == "br":
                say(" ")
            continue
        end()
        link = 0
        if closing:
            if not open_tags[tag]:
                continue
            e = here
            while e.up and e.tag != tag and not (tag not in SCOPES and e.tag in SCOPES):
                e = e.up
            if e.up and e.tag == tag:
                leave(e.up)
            continue
        # a block ends an open paragraph or heading; items end the item before
        if here.tag == "p" or here.tag in HEADINGS and (tag in HEADINGS or tag == "p"):
            leave(here.up)
        if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]):
            e = here
            while e.up and e.tag not in SCOPES and e.tag not in CLOSES[tag]:
                e = e.up
            while e.up and e.tag in CLOSES[tag]:
                e = e.up
                leave(e)
        if tag in VOID:
            continue
        label, hidden, name = _attributes(tag, raw, here.inside) if raw.strip() else (tag, False, "")
        if tag in ("html", "body", "article", "main"):
            hidden, name = False, ""
        elif tag in ("form", "fieldset"):
            name = name or "other"
        out = here.out or tag in DROPPED or tag == "header" and not here.inside or hidden
        if tag in _RAW_END:
            stop = _RAW_END[tag].search(html, at)
            at = stop.start() if stop else n
            if stop and (close := html.find(">", at)) >= 0:
                at = close + 1
            continue
        if not raw.rstrip().endswith("/") or tag in ("p", "div"):
            path = paths.setdefault((here.path, label, name), len(paths) + 1)
            here = _Element(tag, here, len(elements), path, out, name)
            elements.append(here)
            open_tags[tag] += 1
    say(html[at:])
    end()
    return elements, blocks


def _penalised(elements: list[_Element], blocks: list[tuple[_Element, str, int]]) -> list[bool]:
    """By element: it or one above it is named as something else, and what it holds does not clear it."""
    size, main, heads = ([0] * len(elements) for _ in range(3))
    for e, text, _ in blocks:
        size[e.no] += len(text)
        heads[e.no] += e.tag == "h1"
    for e in reversed(elements):  # what stands below comes first
        if e.tag in ("article", "main"):
            main[e.no] = size[e.no]
        if e.up:
            for x in (size, main, heads):
                x[e.up.no] += x[e.no]
    out = []
    for e in elements:
        clear = 2 * main[e.no] > main[0] if main[0] else heads[e.no] == heads[0] > 0
        out.append(e.up is not None and out[e.up.no] or e.name == "comments" or e.name == "other" and not clear)
    return out


def _scores(blocks: list[tuple[_Element, str, int]], low: list[bool]) -> tuple[list[float], list[bool]]:
    """Fused ratios of each block's path, smoothed over the page; whether the path's text is mostly not linked."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for e, text, linked in blocks:
        s = sums[e.path]
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCT.findall(text))
        s[3] += linked
    plain = {p: 1 - s[3] / s[1] for p, s in sums.items()}
    length, marks = ([sums[e.path][k] / sums[e.path][0] * plain[e.path] for e, _, _ in blocks] for k in (1, 2))

    def smooth(x: list[float]) -> list[float]:
        half, out = len(KERNEL) // 2, []
        for i in range(len(x)):
            near = [(w, x[j]) for w, j in zip(KERNEL, range(i - half, i + half + 1)) if 0 <= j < len(x)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [a * (1 + b) * (PENALTY if low[e.no] else 1) for a, b, (e, _, _) in zip(smooth(length), smooth(marks), blocks)]
    return fused, [plain[e.path] >= UNLINKED for e, _, _ in blocks]


def main_text(html: str | None) -> str:
    """The article's blocks, one to a line."""
    elements, blocks = _blocks(html) if html else ([], [])
    if not blocks:
        return ""
    low = _penalised(elements, blocks)
    scores, plain = _scores(blocks, low)
    weights = [len(t) * (PENALTY if low[e.no] else 1) for e, t, _ in blocks]
    bound = THRESHOLD * sum(s * w for s, w in zip(scores, weights)) / sum(weights)
    chosen = [s >= bound for s in scores]
    held = [0.0] * len(elements)
    for (e, _, _), weight, ok in zip(blocks, weights, chosen):
        held[e.no] += weight * ok
    for e in reversed(elements[1:]):
        held[e.up.no] += held[e.no]
    article = max((e for e in elements if held[e.no] >= HOLDS * held[0]), key=lambda e: e.depth)
    while article.up and article.tag in {"p", *HEADINGS}:
        article = article.up  # one paragraph is not the article; what stands beside it counts
    e = article
    while e and e.tag not in ("article", "main"):
        e = e.up
    article = e or article
    below = [False] * len(elements)
    for e in elements[article.no :]:
        below[e.no] = e is article or e.up is not None and below[e.up.no]
    whole = article.tag not in ("", "html", "body")
    kept = []
    for i, ((e, text, linked), ok) in enumerate(zip(blocks, chosen)):
        heading = e.tag in HEADINGS
        if not below[e.no] or low[e.no] and not low[article.no] or not (plain[i] or heading):
            continue
        if whole or ok or heading and i + 1 < len(blocks) and chosen[i + 1]:
            kept.append(text)
    return "\n".join(kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    few = df.select(df[f"`{id_col}`"].alias("page_id"), df[f"`{url_col}`"].alias("url"), df[f"`{html_col}`"].alias("html"))
    kind = few.schema["page_id"].dataType.simpleString()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    return arrow_map(few, read, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
