"""Main text of web pages by host consensus.

Each page's containers are scored by the text that stands in them (links count against it, text of a
child counts half for its parent), boilerplate elements left out. A container is named by its
generalised path: tags and class names from the body down, digits replaced. Every page votes for the
path of its best container: the article or main element around it, or else the nearest ancestor that
holds all text around it that is no list of links. Spark sums the votes by host and path, and the paths
that a host's pages agree on are used to extract all its pages anew, with all containers of that path. A
page whose own vote is among them uses that one; one on which none of them has text uses its own.

A class, id or form marks an element as boilerplate only until the page is known (``_settle``): one that
is, or holds, the article or most of the page's unlinked text is no boilerplate, and neither is prose in
an article under a word that names lists of links elsewhere ("related-work").

A null or empty html, or one without text, gives an empty text. A null url, or one without a host,
counts to the empty host. Ties go to the path that comes first in the alphabet. Repeated rows vote and
are returned as often as they come. Nothing under the path used is dropped or cut. A section of fewer than BESIDE
characters that stands beside the container, has a class of its own and is alone there is not seen as main text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import batches, small_batches, stored
from marketlake.llm.url_filter import split_url

#: A path must have this share of its host's votes to be used.
SHARE = 0.15
#: A table of winning paths of at most so many hosts is broadcast; a larger one is joined in SALTS parts.
BROADCAST_HOSTS, SALTS = 50_000, 16

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+").findall
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I).match

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption hr br address details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = TEXTUAL - {"td", "th", "tr", "br", "caption", "thead", "tbody", "tfoot"} | frozenset("div article section main nav header footer aside form center fieldset".split())
#: What an opening tag closes if it is open, and the elements that shield it.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

DROPPED = frozenset("head nav footer aside script style noscript template iframe button select option textarea input label svg math canvas object embed audio video dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class, id or role that mark an element as no main text.
MARKS = frozenset(
    "ad adbox ads advert adverts advertisement advertising adsbygoogle alert announcement banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "dropdown footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted "
    "promotion rail recommended recommendations related replies reply respond share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription taboola teaser toc toolbar tooltip topbar tracking widget widgets".split()
)
#: Marks of readers' comments: the articles in them are comments too.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Marks of what is no main text however much of the page it fills, unless the article is in it.
FIRM = frozenset("ad adbox ads advert adverts advertisement advertising adsbygoogle captcha consent cookie cookies footer gdpr login menu menus modal nav navbar navigation newsletter popup sidebar sitemap subscribe subscription toolbar topbar".split())
#: Marks that name lists of links; in an article they may be words for prose.
LISTS = frozenset("rail related share sharing social teaser toc tracking widget widgets".split())
#: Of a text under such a word, links may hold less than this share, and it must have so many characters.
LINKED, PROSE = 1 / 3, 100
#: Text beside a container belongs to it from so many characters in a block; straight below the body from so many.
BESIDE, BESIDE_BODY = 25, 80
#: Words that begin or end like these are marks too ("topnav", "advertbox").
ENDS, BEGINS = ("nav", "menu", "sidebar", "footer", "comments"), ("advert", "adsense", "adslot", "breadcrumb", "cookie", "newsletter", "popup", "sidebar")
#: Words beside a mark that take it back: "has-sidebar", "no-ads".
UNLESS = frozenset("has have with no without".split())


def mark_of(name: str) -> str:
    """The kind of mark that a class or id is: comments, firm, some, list, or none."""
    words = WORDS(name)
    if UNLESS.intersection(words):
        return ""
    if any(w in COMMENTS or w.endswith("comments") for w in words):
        return "comments"
    if any(w in FIRM or w.startswith(BEGINS) or w.endswith(ENDS) for w in words) or "side bar" in " ".join(words) or words == ["header"] or words in (["site", "header"], ["page", "header"], ["top", "header"]):
        return "firm"
    marks = [w for w in words if w in MARKS]
    return "" if not marks else "list" if all(w in LISTS for w in marks) else "some"


class Page:
    """Containers and text blocks of one page, in page order."""

    def __init__(self, text: str | None):
        # containers: (parent, tag, number of the path, mark); blocks: (container, text, link characters, heading)
        self.nodes: list[tuple[int, str, int, str]] = [(-1, "body", 0, "")]
        self.blocks: list[tuple[int, str, int, bool]] = []
        # paths: (number of the path above, name, characters), numbered by (path above, name)
        self.paths: list[tuple[int, str, int]] = [(-1, "body", 4)]
        self.numbers: dict[tuple[int, str], int] = {}
        self.pieces: list[str] = []
        self.link_chars = 0
        # open elements: (tag, container, dropped, in a link, in a heading, in an article)
        self.open: list[tuple[str, int, bool, bool, bool, bool]] = [("#", 0, False, False, False, False)]
        if text:
            self._parse(text)
        self._flush()
        self._settle()

    def _add(self, parent: int, tag: str, name: str, mark: str) -> int:
        key = (self.nodes[parent][2], name)
        number = self.numbers.setdefault(key, len(self.paths))
        if number == len(self.paths):
            self.paths.append((*key, self.paths[key[0]][2] + 1 + len(name)))
        self.nodes.append((parent, tag, number, mark))
        return len(self.nodes) - 1

    def path(self, number: int) -> str:
        names = []
        while number >= 0:
            number, name, _ = self.paths[number]
            names.append(name)
        return "/".join(reversed(names))

    def _sums(self) -> tuple[list[int], list[int]]:
        """(unlinked, linked) characters in each container and below it."""
        plain, linked = [0] * len(self.nodes), [0] * len(self.nodes)
        for node, text, links, _ in self.blocks:
            plain[node] += max(0, len(text) - links)
            linked[node] += links
        for k in range(len(self.nodes) - 1, 0, -1):
            plain[self.nodes[k][0]] += plain[k]
            linked[self.nodes[k][0]] += linked[k]
        return plain, linked

    def _settle(self) -> None:
        """Drop the blocks under marks that hold for this page."""
        if not any(mark for _, _, _, mark in self.nodes):
            return
        plain, linked = self._sums()
        size = len(self.nodes)
        said, under, article, holds = [False] * size, [False] * size, [False] * size, [False] * size
        for k, (up, tag, _, mark) in enumerate(self.nodes):
            said[k] = mark == "comments" or (up >= 0 and said[up])
            under[k] = bool(mark) or (up >= 0 and under[up])
            article[k] = tag in ("article", "main") or (up >= 0 and article[up])
            holds[k] = tag in ("article", "main") and not said[k] and plain[k] > 0
        for k in range(size - 1, 0, -1):
            holds[self.nodes[k][0]] |= holds[k]
        # unlinked text outside comments, and of articles outside all marks
        total = clear = 0
        for node, text, links, _ in self.blocks:
            own = max(0, len(text) - links)
            total += 0 if said[node] else own
            clear += own if article[node] and not under[node] else 0
        gone = [False] * size
        for k, (up, _, _, mark) in enumerate(self.nodes):
            gone[k] = up >= 0 and gone[up]
            if not mark or gone[k]:
                continue
            main = mark != "comments" and holds[k] and plain[k] > clear
            most = mark in ("some", "list") and not clear and 2 * plain[k] > total
            prose = mark == "list" and article[up] and plain[k] >= PROSE and linked[k] < LINKED * (plain[k] + linked[k])
            gone[k] = not (main or most or prose)
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                _, node, _, _, heading, _ = self.open[-1]
                self.blocks.append((node, text, self.link_chars, heading))
            self.pieces, self.link_chars = [], 0

    def _text(self, raw: str) -> None:
        _, _, dropped, link, _, _ = self.open[-1]
        if dropped or not raw:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        self.pieces.append(raw)
        if link:
            self.link_chars += len(raw.strip())

    def _close_to(self, depth: int) -> None:
        if any(e[0] not in INLINE for e in self.open[depth:]):
            self._flush()
        del self.open[depth:]

    def _end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self._close_to(depth)
                return
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return  # an inline end tag closes nothing outside its block
        if tag == "p":
            self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == "p":
                    self._close_to(depth)
                    break
                if self.open[depth][0] not in INLINE and self.open[depth][0] not in HEADINGS:
                    break
        if tag in IMPLIED:
            shut, shield = IMPLIED[tag]
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in shield:
                    break
                if self.open[depth][0] in shut:
                    self._close_to(depth)
                    if tag != "tr":
                        break
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text(" ") if tag == "br" else self._flush()
            return
        _, node, dropped, link, heading, article = self.open[-1]
        if tag not in INLINE:
            self._flush()
        names, mark, gone = "", "", tag in DROPPED
        if attributes and not dropped and not gone:
            names, mark, gone = self._named(attributes)
        if tag == "form" and not mark:
            mark = "some"
        if mark and tag in INLINE:
            gone = True
        if tag == "header" and not article:
            gone = True
        if tag == "header" and article:  # an article's own header: its headings stay
            self.open.append((tag, node, True, link, heading, article))
            return
        above = self.open[-1][0] == "header" and tag in HEADINGS and article
        gone = gone or (dropped and not above)
        if not gone and tag not in INLINE and (mark or tag not in TEXTUAL):
            node = self._add(node, tag, tag + names, mark)
        self.open.append((tag, node, gone, link or tag == "a", heading or tag in HEADINGS, article or tag in ("article", "main")))

    def _named(self, attributes: str) -> tuple[str, str, bool]:
        """(generalised class names as a suffix, kind of mark or none, whether the element is hidden or no text)."""
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return "", "", True
        if found.get("role", "").lower() in ROLES:
            return "", "", True
        classes = sorted(set(re.sub(r"\d+", "#", found.get("class", "")).lower().split()))
        kinds = {mark_of(name) for name in [*classes, re.sub(r"\d+", "#", found.get("id", "")).lower()]}
        return "".join(f".{c}" for c in classes), next((k for k in ("comments", "firm", "some", "list") if k in kinds), ""), False

    def _parse(self, text: str) -> None:
        at, low = 0, None
        if len(text.lower()) != len(text):  # then places in the lowered text would be others
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        while m := TOKEN.search(text, at):
            self._text(text[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in RAW and not m[3].endswith("/"):
                low = low or text.lower()
                end = low.find(f"</{tag}", at)
                close = text.find(">", end) if end >= 0 else -1
                at = len(text) if close < 0 else close + 1
                continue
            self._start(tag, m[3])
            if m[3].endswith("/") and tag in ("svg", "math", "object", "iframe"):
                self._close_to(len(self.open) - 1)
        self._text(text[at:])

    def scores(self) -> list[float]:
        """Of each container: its own text without links, and half of its children's scores."""
        out = [0.0] * len(self.nodes)
        for node, text, links, heading in self.blocks:
            own = max(0, len(text) - 2 * links)
            out[node] += own * (0.25 if heading else 1.0) + (10 if own > 80 else 0)
        for k in range(len(self.nodes) - 1, 0, -1):
            out[self.nodes[k][0]] += out[k] / 2
        return out

    def best(self) -> tuple[int, float] | None:
        """(number of the path, score) of what the page votes for."""
        if not self.blocks:
            return None
        scores = self.scores()
        score = max(scores)
        if score <= 0:  # nothing but links
            return 0, 0.0
        ties = [k for k, x in enumerate(scores) if x == score]
        k = ties[0]
        if len(ties) > 1:
            numbers = {self.nodes[t][2] for t in ties}
            first = min(numbers, key=self.path) if len(numbers) > 1 else self.nodes[k][2]
            k = next(t for t in ties if self.nodes[t][2] == first)
        up, chosen = k, k
        while up > 0:
            if self.nodes[up][1] == "article" or (self.nodes[up][1] == "main" and self.nodes[chosen][1] != "article"):
                chosen = up
            up = self.nodes[up][0]
        if self.nodes[chosen][1] not in ("article", "main"):
            chosen = self._around(k)
        return self.nodes[chosen][2], score

    def _around(self, k: int) -> int:
        """The nearest ancestor of container ``k`` that holds the text around it."""
        number = self.nodes[k][2]
        level, up, steps = {}, k, 0  # each ancestor's number of steps above k
        while up >= 0:
            level[up] = steps
            up, steps = self.nodes[up][0], steps + 1
        meets = [0] * len(self.nodes)  # the nearest of these at or above each container
        for n, (up, _, _, _) in enumerate(self.nodes):
            meets[n] = n if n in level else meets[up]
        plain, linked = self._sums()
        top = k
        for node, text, links, heading in self.blocks:
            at = meets[node]
            if level[at] <= level[top] or heading or COPYRIGHT(text):
                continue
            own, most = len(text) - links, BESIDE if at else BESIDE_BODY
            if 2 * linked[node] < plain[node] + linked[node] and (own >= most or self.nodes[node][2] == number):
                top = at
        return top

    def under(self, roots: set[int]) -> str:
        """The text in these containers, and headings that stand right before them in their own parent."""
        inside = []
        for k, (parent, _, _, _) in enumerate(self.nodes):
            inside.append(k in roots or (parent >= 0 and inside[parent]))
        above = {self.nodes[k][0] for k in roots} - {0, -1}
        first = next((k for k, b in enumerate(self.blocks) if inside[b[0]]), 0)
        return " ".join(text for k, (node, text, _, heading) in enumerate(self.blocks) if inside[node] or (k < first and heading and node in above))

    def extract(self, paths: list[str]) -> tuple[str, str]:
        """(text, path used): under the page's own path if it is one of ``paths``, else under the first of them
        that the page has text at, else under its own."""
        own = self.best()
        if own is None:
            return "", ""
        plain, linked = self._sums()
        mine = self.path(own[0])
        for path in [mine] if mine in paths else paths:
            at = {k for k, n in enumerate(self.nodes) if self.paths[n[2]][2] == len(path) and plain[k] + linked[k] and self.path(n[2]) == path}
            if at:
                return self.under(at), path
        return self.under({k for k, n in enumerate(self.nodes) if n[2] == own[0]}), mine


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, weight): how many pages of a host vote for a path."""

    def run(it):
        for whole in it:
            for b in batches([whole], 2_000_000):
                rows = []
                for url, text in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(text)
                    if best := page.best():
                        rows.append((split_url(url)[0], page.path(best[0]), best[1]))
                columns = zip(*rows, strict=True) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["host", "path", "score"])

    found = pages.select("url", "html").mapInArrow(run, "host string, path string, score double")
    return found.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("weight"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with at least ``share`` of the votes of the host (so few of them), most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    good = counted.join(total, "host").where(F.col("votes") >= F.col("total") * share)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path")))
    return good.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    won = stored(winners(stored(votes(rows), "html-votes")), "html-winners")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    keyed = rows.withColumn("_host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    if won.count() <= BROADCAST_HOSTS:
        keyed = keyed.join(F.broadcast(won), keyed["_host"] == won["host"], "left")
    else:  # one host may hold a third of the pages: its row is copied to SALTS keys
        spread = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        keyed = keyed.join(spread, (keyed["_host"] == spread["host"]) & (keyed["_s"] == spread["_salt"]), "left")

    def run(it):
        for whole in it:
            for b in batches([whole], 2_000_000):
                found = [Page(t).extract(p or []) for t, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
                text, path = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(path, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return keyed.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
