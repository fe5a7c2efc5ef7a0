"""Main text of web pages by scoring the element tree.

Each paragraph passes points, one and more for its length and commas, to its ancestors, less with each level and less
the more of its text lies in links. The container with most points is kept, with those of its siblings that score like
content; what is a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment by its element,
role, class or id is left out first; a name that only holds such a word (share-price) counts where the box has no text to
speak of outside of links. Lists of links stay, but for those before or after all paragraphs of a page without an article
or main element.

Null or empty html gives an empty text, as do pages without content. Each row gives one row, repeated or not; an empty
table gives an empty one; other columns are ignored. Markup cut off at the end is dropped, unclosed elements end with
their parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import session, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea|title|select|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\s+(?:\"[^\"]*\"|'[^']*'|[^'\">])*|/)?)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button input dialog menu audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4".split())
TOPS = frozenset("html body article main".split())
#: Parts of names of what is no article text, and parts that say nothing beside them.
KNOWN = re.compile(
    r"ads?|advert\w*|adbox|adsense|sponsor\w*|promo(?:s|tions?|ted)?|banner|sidebar|side|aside|nav(?:bar|igation|menu|list|s)?|menu|topbar|toolbar|breadcrumbs?|masthead|header|footer|foot|bottom"
    r"|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search|share|sharing|social|related|recommend\w*|widget|pagination|pager|copyright|legal|disclaimer|skip|tags"
)
GENERIC = frozenset("box bar button buttons btn wrapper wrap container inner outer list links link form area block section site page top left right panel item items post posts article articles story stories icon icons row col column global primary secondary body text author user users thread meta count reply policy info message field input group unit slot dialog bottom main big small fixed sticky new more read also this cloud".split())
#: Before a name, what makes it mean something else; and, inside an article, names of its own parts.
OTHER = re.compile(r"(?:no|has|with|without|main|content|article)[-_]")
OWN = frozenset(["header", "banner"])
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Points of an ancestor's share, by its distance from the paragraph.
SHARES = (1.0, 0.5, 0.25, 0.125)
LINKED = 0.6
#: Words outside of links below which a box whose name may mean something else isn't text.
FEW_WORDS = 5


def _named(name: str, inside: bool) -> int:
    """2: a name of no article text; 1: one that has such a part beside others, and may be; 0: another."""
    parts = [p for p in re.split(r"[-_]+|(?<=\D)(?=\d)", name) if p and not p.isdigit()]
    known = [p for p in parts if KNOWN.fullmatch(p)]
    if not known or OTHER.match(name):
        return 0
    return 1 if inside and OWN.intersection(known) or any(p not in known and p not in GENERIC for p in parts) else 2


def _unwanted(tag: str, attributes: str, inside: bool) -> int:
    """3: by its element or role; 2: by a name; 1: by a name that may mean something else; 0: not unwanted. inside: of an article."""
    if tag in DROPPED or tag == "header" and not inside:
        return 3
    if not attributes or tag in TOPS:
        return 0
    most = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return 3
        if key == "role" and value in ROLES:
            return 3
        if key in ("class", "id") and tag not in INLINE:
            most = max([most, *(_named(x, inside) for x in value.split())])
    return most


class _Page:
    """Nodes in page order, each with its parent's place; runs of text with the node they are in, None for a new block."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.unwanted = ["#root"], [-1], [0]
        self.runs: list[tuple[int, str | None]] = []
        open_, at = [0], 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.runs.append((open_[-1], html[at : m.start()]))
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            block = tag not in INLINE
            if block:
                self.runs.append((open_[-1], None))
            if m[2]:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == tag:
                        del open_[k:]
                        break
                    if not block and self.tag[open_[k]] not in INLINE:  # an inline end tag ends no block
                        break
                continue
            if tag in VOID:
                continue
            if block and tag not in ("td", "th"):
                self._end(open_, ("p",), ("table", "td", "th", "div", "section", "article", "blockquote", "li"))
            if tag in ENDS:
                self._end(open_, ENDS[tag], ("ul", "ol", "dl", "table"))
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.unwanted.append(_unwanted(tag, m[4], any(self.tag[k] in ("article", "main") for k in open_)))
            if not m[4].endswith("/"):
                open_.append(len(self.tag) - 1)
        if at < len(html):
            self.runs.append((open_[-1], html[at:]))

    def _end(self, open_: list[int], tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if self.tag[open_[k]] in tags:
                del open_[k:]
                return
            if self.tag[open_[k]] in stop:
                return

    def _doubtful(self, linked: list[bool]) -> list[bool]:
        """Whether most of a node's text lies in links, or hardly any outside of them."""
        n = len(self.tag)
        words, plain = [0] * n, [0] * n
        for k, t in self.runs:
            if t:
                size = len(t.split())
                words[k] += size
                plain[k] += size * (not linked[k])
        for k in range(n - 1, 0, -1):
            words[self.parent[k]] += words[k]
            plain[self.parent[k]] += plain[k]
        return [p < FEW_WORDS or 2 * p < w for p, w in zip(plain, words, strict=True)]

    def text(self, least: int) -> str:
        """The main text without nodes that are unwanted by at least this much, nor those that may be and have no text to speak of."""
        n = len(self.tag)
        out, linked, inner = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            linked[k] = linked[self.parent[k]] or self.tag[k] == "a"
            inner[k] = inner[self.parent[k]] or self.tag[k] in ("article", "main")
        doubtful = self._doubtful(linked) if 1 in self.unwanted else []
        for k in range(1, n):
            out[k] = out[self.parent[k]] or self.unwanted[k] >= least or self.unwanted[k] == 1 and doubtful[k]
        length, links, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
        runs = [(k, t if t is None else unescape(t)) for k, t in self.runs if not out[k]]
        for k, t in runs:
            if t and (size := len(" ".join(t.split()))):
                length[k] += size
                links[k] += size * linked[k]
                commas[k] += t.count(",")
                while k and self.tag[k] in INLINE:
                    k = self.parent[k]
                own[k] += size
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            length[p] += length[k]
            links[p] += links[k]
            commas[p] += commas[k]
        density = [a / b if b else 0.0 for a, b in zip(links, length, strict=True)]
        score = [0.0] * n
        for k in range(n):
            paragraph = self.tag[k] in PARAGRAPHS
            if out[k] or not own[k] or self.tag[k] in INLINE:
                continue
            points = (1 + commas[k] * (paragraph or own[k] > length[k] / 2) + min(own[k] / 100, 3)) * (1 - density[k])
            p = self.parent[k] if paragraph and k else k
            for share in SHARES:
                score[p] += points * share
                if not p:
                    break
                p = self.parent[p]
        for k in range(n):
            if self.tag[k] in ("article", "main"):
                score[k] += 25 * (length[k] > 0)
            score[k] *= 1 - density[k]
        best = max(range(n), key=lambda k: (score[k], -k))
        if score[best] <= 0:
            return ""
        keep = {best}
        if best:
            for k in range(1, n):
                if self.parent[k] == self.parent[best] and not out[k] and (score[k] >= max(10.0, 0.2 * score[best]) or self.tag[k] == "p" and density[k] < 0.25 and length[k] > 80):
                    keep.add(k)
        kept = [False] * n
        for k in range(n):
            kept[k] = k in keep or k > 0 and kept[self.parent[k]]
        told = [k for k in range(n) if kept[k] and not out[k] and self.tag[k] in ("p", "blockquote", "pre", "h1") and length[k] and density[k] < 0.25]
        first, last = (told[0], told[-1]) if told else (0, n)
        inside = [False] * n
        for k in range(n):
            # links alone, before or after all paragraphs of a page that doesn't say where its article is
            menu = k not in keep and not inner[k] and not first < k < last and self.tag[k] in ("ul", "ol", "div", "section", "table", "dl") and density[k] > LINKED
            inside[k] = (k in keep or k > 0 and inside[self.parent[k]]) and not menu and not out[k]
        blocks, block = [], []
        for k, t in runs:
            if t is None:
                blocks.append("".join(block))
                block = []
            elif inside[k]:
                block.append(t)
        blocks.append("".join(block))
        return " ".join(s for b in blocks if (s := " ".join(b.split())))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page(html)
    return page.text(2) or page.text(3)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    session(pages)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
