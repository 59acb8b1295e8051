"""Main text of web pages by consensus paths of hosts.

A page is read once into blocks of text, each with its container: the innermost structural element, described by its
generalised path of tags and classes (numbers dropped). Containers are scored by their text (length, less links and
boilerplate names). In Spark, the scores of a host's pages are summed by path, so a host votes for the paths that hold
its articles; pages are then extracted again with their host's winning paths. A page of which they hold too little uses its
own best. The html stays where it is: only votes are shuffled and winners sent, unless there are very many hosts.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, map_rows

#: HTML elements by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea label fieldset iframe object svg canvas audio video menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that end an open p, and elements that end an open one of the same kind.
RAW = frozenset("script style textarea title".split())
SAME = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark what is no article.
NAMES = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment\w*|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo\w*|related|recommend\w*|respond|replies|reply|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|widget\w*|complementary|contentinfo|search)(?:[^a-z]|$)"
)
#: Words among them that inside a marked article may stand for parts of it.
INSIDE = re.compile(r"\b(?:related|recommend\w*|share|sharing|side|skip|social|tags?|search)\b")
#: Names that only speak of such a box: what surrounds or lacks one, and parts of articles.
NO_BOX = re.compile(r"(?:^|(?<=\s))(?:(?:has|have|no|not|with|without|dept|editors?)-\S+|(?:section|article|entry|post|story)-header)(?=\s|$)")
#: Elements skipped for their names count after all if they hold more than this share of the page's text, and what no such element holds is less than that.
MOST, REST = 0.5, 0.1
TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*(?:"|$)|'[^']*(?:'|$))?|["'])*+)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
#: Share of the leading path's votes that makes another path of the host a winner too; hosts up to which the winners are broadcast.
FAIR, HOSTS = 0.25, 200_000
#: A container that says it is the article.
MARKED = re.compile(r">(?:article|main)(?=[.>]|$)")
FIRST_ARTICLE = re.compile(r".*?>article[^>]*")
#: Share of its page's text that a host's path must hold to be taken; least share of the winner's text, and most share of links, of a sibling that joins it.
HOLDS, JOINS, LINKS = 0.5, 0.1, 0.25


class Page:
    """``blocks``: (path of the container, text, characters in links), in page order."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str, int]] = []
        # Open elements: (tag, path of its container, skipped, in a link, numbers of the elements around it that have the name of a box).
        stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
        boxes: list[tuple[int, ...]] = []
        n_boxes = 0
        text: list[str] = []
        linked = 0
        html = html or ""
        at, path_of_text, boxes_of_text = 0, "", ()

        def flush():
            nonlocal linked
            if text:
                joined = SPACE.sub(" ", unescape("".join(text))).strip()
                if joined:
                    self.blocks.append((path_of_text, joined, linked))
                    boxes.append(boxes_of_text)
                text.clear()
            linked = 0

        while True:
            found = TAG.search(html, at)
            end = found.start() if found else len(html)
            if end > at and not stack[-1][2]:
                if not text:
                    path_of_text, boxes_of_text = stack[-1][1], stack[-1][4]
                text.append(html[at:end])
                linked += (end - at) * stack[-1][3]
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            closing, tag, rest = found[1], found[2].lower(), found[3]
            if tag in BLOCKS:
                flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "body", "td", "main") and tag in ("p", "b", "i", "em", "strong", "span", "a"):
                        break
                continue
            if ends := SAME.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "table", "dl", "select"):
                        break
            elif tag in BLOCKS and tag != "br" and stack[-1][0] == "p":
                stack.pop()
            if tag in VOID:
                continue
            named, gone, box = "", tag in SKIPPED, False
            if rest and rest != "/":
                for name, *values in ATTRIBUTE.findall(rest):
                    value = next(filter(None, values), "").lower()
                    telling = NO_BOX.sub("", value)
                    telling = INSIDE.sub("", telling) if MARKED.search(stack[-1][1]) else telling
                    gone = gone or name.lower() == "hidden"
                    box = box or bool(NAMES.search(telling)) and tag not in ("html", "body", "main", "article")
                    if name.lower() == "class":
                        named = ".".join(sorted({re.sub(r"\d+", "", w) for w in value.split()}))
            path, skipped = stack[-1][1], stack[-1][2] or gone
            if tag in CONTAINERS:
                path = f"{path}>{tag}{'.' + named if named else ''}"
            if box and tag not in BLOCKS:  # a part of a line goes at once
                skipped, box = True, False
            n_boxes += box
            stack.append((tag, path, skipped, stack[-1][3] or tag == "a", (*stack[-1][4], n_boxes) if box else stack[-1][4]))
            if tag in RAW and not rest.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(html, at)
                at = close.start() if close else len(html)
        flush()
        held: dict[int, int] = {}
        for (_, joined, _), around in zip(self.blocks, boxes, strict=True):
            for k in (0, *around):
                held[k] = held.get(k, 0) + len(joined)
        total, free = held.get(0, 0), sum(len(b[1]) for b, around in zip(self.blocks, boxes, strict=True) if not around)
        large = {k for k, n in held.items() if n > MOST * total} if free < REST * total else set()
        self.blocks = [b for b, around in zip(self.blocks, boxes, strict=True) if large.issuperset(around)]

    def scores(self) -> dict[str, float]:
        """Per container path the characters of text outside links, with more weight where an element says it is the article."""
        out: dict[str, float] = {}
        for path, text, linked in self.blocks:
            # A block counts for its container and, less, for those around it.
            weight = 1.0
            while path:
                says = 2.0 if re.search(r">(?:article|main)[^>]*$", path) else 1.0
                out[path] = out.get(path, 0.0) + weight * says * max(len(text) - 2 * linked, 0)
                path, weight = path.rpartition(">")[0], weight * 0.6
        return out

    def text(self, paths: list[str] | None) -> str:
        """The main text: the blocks of the container that the host's ``paths`` name, or of the page's own best where they hold too
        little of it; with the whole article around it if one is marked, else with its siblings that read like it."""
        if not (scores := self.scores()):
            return "\n".join(t for _, t, _ in self.blocks)  # a fragment without any container
        within = lambda p, root: p == root or p.startswith(root + ">")
        plain = lambda root: sum(max(len(t) - 2 * linked, 0) for p, t, linked in self.blocks if within(p, root))
        total = sum(max(len(t) - 2 * linked, 0) for _, t, linked in self.blocks)
        best = max((p for p in sorted(paths or ()) if p in scores and plain(p) >= HOLDS * total), key=scores.get, default=None)
        best = best or max(sorted(scores), key=scores.get)
        if marks := list(MARKED.finditer(best)):  # the outermost article, unless a main holds several things
            first = next((m for m in marks if m[0] == ">article"), marks[0])
            best = best[: next((k for k in range(first.end(), len(best)) if best[k] == ">"), len(best))]
        parent, roots = best.rpartition(">")[0], [best]
        if best.rpartition(">")[2].startswith("article"):  # further articles of the page
            weight = plain(best)
            for near in sorted({m[0] for p, _, _ in self.blocks if (m := FIRST_ARTICLE.match(p)) and not within(p, best)}):
                whole, linked = sum(len(t) for p, t, _ in self.blocks if within(p, near)), sum(n for p, _, n in self.blocks if within(p, near))
                if plain(near) >= JOINS * weight and linked <= LINKS * whole and not within(best, near) and not NAMES.search(near.rpartition(">")[2].replace(".", " ")):
                    roots.append(near)
        if parent and not MARKED.search(best):
            weight = plain(best)
            for near in sorted({p[: p.find(">", len(parent) + 1)] if p.find(">", len(parent) + 1) > 0 else p for p, _, _ in self.blocks if p.startswith(parent + ">")} - {best}):
                whole, linked = sum(len(t) for p, t, _ in self.blocks if within(p, near)), sum(n for p, _, n in self.blocks if within(p, near))
                if plain(near) >= JOINS * weight and linked <= LINKS * whole:
                    roots.append(near)
            loose = parent.rpartition(">")[2] != "body"  # text of the parent itself, such as a heading above the container
        else:
            loose = False
        return "\n".join(t for p, t, _ in self.blocks if any(within(p, r) for r in roots) or loose and p == parent)


def host_of(url):
    """The url's host in lower case without ``www.`` and port; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), r"^www\.", "")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row.

    Null and empty html give an empty text; pages are read whole. Pages without a host are each judged alone. Scores that tie
    go to the path first in order. Ids may be null or repeat; other columns are ignored. An empty table gives no rows.
    """
    kind = dict(pages.dtypes)[id_col]
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def votes():
        def out(rows):
            total: dict[tuple[str, str], float] = {}
            for r in rows:
                scores = Page(r["html"]).scores() if r["host"] else {}
                best = sum(scores.values()) or 1.0
                for path, s in scores.items():  # each page has one vote, shared out
                    total[r["host"], path] = total.get((r["host"], path), 0.0) + s / best
            return [(*k, round(v * 1e6)) for k, v in total.items()]

        return out

    cast = map_rows(pages.where("host <> ''").select("host", "html"), votes, "host string, path string, votes bigint", chunks=True)
    cast = cut(cast.groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    top = cast.groupBy("host").agg(F.max("votes").alias("top"))
    # Paths with a fair share of the leader's votes: a host may have several templates.
    won = cut(cast.join(top, "host").where(F.col("votes") >= FAIR * F.col("top")).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths")))

    def extract():
        return lambda r: [(r["page_id"], r["url"], Page(r["html"]).text(r["paths"]))]

    return map_rows(pages.join(if_small(won, HOSTS), "host", "left").select("page_id", "url", "html", "paths"), extract, f"page_id {kind}, url string, text string")
