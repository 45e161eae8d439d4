"""The main text of web pages, by container paths on which the pages of a host agree.

Every page is cut into blocks of text, each in its container. Containers are scored by the text in
them; the best one's path of tags and classes, with what varies from page to page taken out, is the
page's vote. Votes are counted by host in Spark, and the text of each page is then taken from the
containers on its host's winning path, or from its own best one where the page has none of these.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import mapped, slices, table, written
from .lookup import looked_up
from .url_filter import LOWER, UPPER

#: Winning paths of a host that a page is tried with, one after the other, and the share of its votes that each has at least.
WINNERS, LEAST_SHARE = 3, 0.1
#: Hosts, at most so many, whose winning paths are broadcast.
FEW_HOSTS = 50_000
# Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that hold no text of an article.
NOISE_TAGS = frozenset("nav footer aside form head script style textarea title iframe noembed noframes noscript template button select datalist object svg canvas audio video map dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of classes and ids of what stands around articles.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars menu menus nav navi navbar navigation breadcrumb breadcrumbs "
    "toolbar header masthead footer colophon comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr alert popup popover modal overlay lightbox newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets pagination pager paginator search skip copyright".split()
)
#: Last words of classes and ids of the text itself.
TEXT_WORDS = frozenset("article content post entry story main text body".split())
#: Beginnings of class words that speak of something else than the element itself.
NOT_ITSELF = frozenset("has have with without no not is".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCKS - frozenset("caption dd dt html body legend li optgroup option rp rt summary tbody td tfoot th thead tr figcaption".split()) | {"hr"}
#: What an element ends when it opens, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
CELLS, TABLE = frozenset("td th caption table template".split()), frozenset("table thead tbody tfoot tr td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block each; a block counts for the container around them. A cell may hold a whole page's text.
LEAVES = HEADINGS | frozenset("p pre blockquote li dt dd th tr tbody thead tfoot table ul ol dl figure figcaption caption summary details center address hgroup fieldset legend option optgroup".split())

#: A comment, a declaration, or a tag with its attributes; quotes without an end end at the tag's own end.
MARK = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")


def _is_noise(tag: str, names: str, role: str) -> bool:
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return True
    if not names or tag in ("html", "body", "article", "main"):
        # The article itself may be called anything but a comment.
        return tag == "article" and any(p in ("comment", "comments", "reply") for p in PART.findall(names))
    each = [PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) for name in names.split()]
    noisy = [p for p in each if p and p[0] not in NOT_ITSELF and (p[0] in NOISE_WORDS or p[-1] in NOISE_WORDS)]
    if noisy and any(p and p[-1] in TEXT_WORDS and p[0] not in NOISE_WORDS for p in each):
        # Beside a name for the text itself, as in `post-content share-enabled`, only what is nothing else counts.
        return any(all(w in NOISE_WORDS for w in p) for p in noisy)
    return bool(noisy)


class Page:
    """The containers of a page, in page order, and its blocks of text outside of what surrounds an article."""

    def __init__(self, html: str):
        #: Of each container: the one around it, its tag, its general path.
        self.parents, self.tags, self.paths = [-1], [""], [""]
        #: (container, text, characters within links, heading)
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, container, noise, block
        inline: dict[str, int] = {}  # open tags that are noise and no blocks
        noisy = links = linked = 0
        here, heading = 0, 0
        text: list[str] = []
        article = before = 0  # open ones, and blocks before them
        titled: list[tuple[int, int]] = []  # blocks of a header within an article, from and to
        header_from: list[tuple[int, int]] = []  # depth, blocks

        def close() -> None:
            nonlocal linked
            if text:
                words = unescape("".join(text)).split()
                if words:
                    self.blocks.append((here, " ".join(words), linked, heading > 0))
                text.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal here, noisy, heading, article
            while len(stack) > to:
                tag, container, noise, block = stack.pop()
                if block and not noisy:
                    close()
                noisy -= noise
                if not block:
                    inline[tag] -= 1
                heading -= tag in HEADINGS
                article -= tag == "article"
                if header_from and header_from[-1][0] == len(stack):
                    titled.append((header_from.pop()[1], len(self.blocks)))
                here = container

        at, end = 0, len(html)
        while m := MARK.search(html, at):
            start = m.start()
            if start > at and not noisy:
                piece = html[at:start]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "body" or tag == "html":
                    continue  # what follows still belongs to it
                if tag in BLOCKS or tag in NOISE_TAGS or inline.get(tag):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            pop(k)
                            break
                        if stack[k][0] in CELLS and tag not in TABLE:
                            break
                elif tag == "a":
                    links = 0
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br" and not noisy:
                    text.append(" ")
                continue
            if tag == "hr":
                if not noisy:
                    close()
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                # No markup up to its end tag, which is then read as that of no open element.
                close_at = re.compile(f"</{tag}\\b", re.I).search(html, at)
                at = close_at.start() if close_at else end
                continue
            attributes = m[3]
            names = role = ""
            classes: list[str] = []
            if len(attributes) > 4:
                for a in ATTRIBUTE.finditer(attributes):
                    value = a[2] or a[3] or a[4] or ""
                    what = a[1].lower()
                    if what == "role":
                        role = value.strip().lower()
                    elif what == "itemprop":
                        if value == "articleBody":
                            classes.append("@body")
                    else:
                        names += " " + value
                        if what == "class":
                            classes += value.lower().split()
            noise = _is_noise(tag, names, role)
            block = tag in BLOCKS
            kept_header = tag == "header" and article and not noise and not noisy and len(self.blocks) == before
            noise = noise or tag == "header" and not kept_header
            if tag == "a" and not noise:
                links = 1
            if not (block or noise or inline.get(tag)) or not block and attributes.endswith("/>"):
                continue
            if block:
                if not noisy:
                    close()
                if tag in ENDS_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            pop(k)
                            break
                        if stack[k][3]:
                            break
                if tag in ENDS:
                    ended, until = ENDS[tag]
                    to = len(stack)
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in until:
                            break
                        if stack[k][0] in ended:
                            to = k
                    pop(to)
            if kept_header:
                header_from.append((len(stack), before))  # what begins an article is kept if it has a heading
            stack.append((tag, here, noise, block))
            noisy += noise
            if not block:
                inline[tag] = inline.get(tag, 0) + 1
                continue
            heading += tag in HEADINGS
            if tag == "article":
                before = before if article else len(self.blocks)
                article += 1
            if not noisy and tag not in LEAVES and tag not in ("html", "body"):
                general = sorted({DIGITS.sub("#", c) for c in classes})
                self.parents.append(here)
                self.tags.append("article" if "@body" in general else tag if role != "main" else "main")
                self.paths.append("/".join(filter(None, [self.paths[here], ".".join([tag, *general])])))
                here = len(self.parents) - 1
        if at < end and not noisy:
            text.append(html[at:])
        pop(0)
        close()
        drop = {k for a, b in titled if not any(self.blocks[k][3] for k in range(a, b)) for k in range(a, b)}
        if drop:
            self.blocks = [b for k, b in enumerate(self.blocks) if k not in drop]

    def best(self) -> int:
        """The container with the highest score; -1 for a page without text.

        A block counts in full for its container and by half for each one further out; an article counts
        all of what is in it. Links do not count. Then outwards as far as only headings come in.
        """
        n = len(self.parents)
        direct, scores, headless, count = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        for container, text, linked, heading in self.blocks:
            direct[container] += max(0, len(text) - linked)
            count[container] += 1
            headless[container] += not heading
        whole = direct[:]
        for k in range(n - 1, -1, -1):  # what is inside comes later
            scores[k] += direct[k]
            if self.tags[k] == "article":
                scores[k] = whole[k]
            elif self.tags[k] == "main":
                scores[k] = max(scores[k], 0.9 * whole[k])
            if k:
                scores[self.parents[k]] += scores[k] / 2
                whole[self.parents[k]] += whole[k]
                headless[self.parents[k]] += headless[k]
                count[self.parents[k]] += count[k]
        if not self.blocks:
            return -1
        best = max(range(n), key=lambda k: (scores[k], -k))
        if not scores[best]:
            best = 0  # nothing but links
        outer = self.parents[best]
        while outer > 0 and headless[outer] == headless[best] and self.tags[best] != "article":
            if count[outer] > count[best]:
                best = outer
            outer = self.parents[outer]
        return best

    def text(self, chosen: list[int]) -> str:
        """The blocks within the containers, in page order, one a line."""
        inside = [False] * len(self.parents)
        for k in chosen:
            inside[k] = True
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return "\n".join(text for container, text, _, _ in self.blocks if inside[container])

    def on(self, paths: list[str]) -> str | None:
        """The text on the first of the paths that the page has text on; None where it has on none. The page as a whole is no path."""
        for path in paths:
            if path and (found := self.text([k for k, p in enumerate(self.paths) if p == path])):
                return found
        return None


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many pages of a host have their best container on a path. Pages without host or text have no vote."""

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, column="html"):
                paths = []
                for html in part.column("html").to_pylist():
                    page = Page(html or "")
                    best = page.best()
                    paths.append(None if best < 0 else page.paths[best])
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    read = mapped(_hosted(pages).where("host <> ''").select("host", "html"), vote, "host string, path string")
    return read.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count("*").alias("n"))


def winners(counted: DataFrame, most: int = WINNERS, least: float = LEAST_SHARE) -> DataFrame:
    """host, paths (with most votes first, equal ones by name), n (all votes of the host)."""
    first = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    total = counted.groupBy("host").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).join(total.withColumnRenamed("n", "all"), "host").where(F.col("n") >= least * F.col("all"))
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"), F.max("all").alias("n"))


def _hosted(pages: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.when(F.instr("url", "://") > 0, F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"\A[^/?#]*", 0))
    return own.select("*", F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")).alias("host"))


def extracted(pages: DataFrame, few_hosts: int = FEW_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every page; the text is empty where there is none.

    Null html: empty. Pages without a host, whose url is null or has no ://, go by themselves. Page_ids
    may repeat or lack, rows are pages of their own; further columns play no part. No pages: no rows.
    """

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, column="html"):
                texts = []
                for html, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist()):
                    page = Page(html or "")
                    found = page.on(paths or [])
                    if found is None:
                        best = page.best()
                        found = "" if best < 0 else page.text([best])
                    texts.append(found)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = written(winners(votes(pages)), "host-paths")
    parts = [p.select("page_id", "url", "html", "paths") for p in looked_up(_hosted(pages), chosen, ["host"], "n", few_hosts) if p is not None]
    out = [mapped(p, extract, "page_id long, url string, text string, n_chars long") for p in parts]
    return out[0] if len(out) == 1 else out[0].union(out[1])


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
