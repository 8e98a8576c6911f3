"""Main text of web pages by consensus host paths.

Every page's containers are scored, their places in the page are generalised to paths of tags and classes, and the pages of a host vote
for paths in Spark. Each page is then read again with its host's winning paths: what lies in a container on such a path is
the article, and what lies on the page's own best path too where the winners miss it, without the parts that are menus, notices, adverts, forms or comments.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "iframe", "audio", "video", "textarea", "select", "title")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
                   "td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr blockquote".split())
BESIDE = frozenset("nav header footer aside form menu dialog button fieldset search head".split())
#: Inline elements whose text is apart from what is around it; ``text`` is a label in an svg.
SPACED = frozenset("br text svg object canvas button".split())
FIELDS = frozenset("input textarea select button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote figcaption".split())
# Words of class names, ids and roles that mark what is beside the article.
BESIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promoted "
                         "promotion nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs crumb crumbs sidebar sidebars aside rail "
                         "header masthead topbar footer foot bottombar copyright legal imprint cookie cookies consent gdpr notice notices "
                         "alert alerts disclaimer warning popup modal overlay dialog newsletter subscribe subscription signup login register "
                         "form forms search searchbox comment comments commentlist disqus discussion discussions reply replies respond responses "
                         "share sharing social follow related recommended recommendations recommend trending popular teaser teasers "
                         "widget widgets pagination pager skip toolbar toc tags taglist complementary contentinfo".split())
# Those of them that mean nothing else; a role is always meant. The others also name parts of articles (see ``_Doubt``).
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos cookie cookies gdpr "
                       "nav navbar menubar breadcrumb breadcrumbs sidebar sidebars popup modal newsletter comment comments commentlist disqus "
                       "pagination pager".split())
# Those of the others that name what an article is read without, even inside it.
NAMED_WORDS = frozenset("menu menus navigation notice notices banner banners footer promotion promoted consent".split())
# Those of the others that part an article element from the article of the page.
APART_WORDS = frozenset("related recommended recommendations trending popular teaser teasers promoted".split())
#: Outside article elements, a doubted container is beside the article up to this part of the rest of the page.
REST_SHARE = 0.2
#: What an article or main element, and what a container with a name of ``MAIN_WORDS``, may lose of a page's plain text to the one around it.
ELEMENT_BONUS, NAME_BONUS = 0.25, 0.05
MAIN_WORDS = frozenset("article articlebody post postbody entry story content main maincontent body text".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)|</{tag}[\s/][^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"),
          "option": ("select",)}


@dataclass
class Block:
    """A run of text between block boundaries, and where it stands: the path of the innermost open container."""

    text: str
    path: str
    beside: bool
    linked: int
    head: bool = False


@dataclass
class _Open:
    """An open element; all but ``tag`` holds for what it contains. ``muted`` is text of an inline element that is beside the article."""

    tag: str
    path: str
    beside: bool
    links: bool
    title: bool = False
    doubts: tuple[int, ...] = ()
    muted: bool = False
    article: bool = False


@dataclass
class _Doubt:
    """A container with a word that may mark it as beside the article, and what it holds."""

    inside: bool
    named: bool
    size: int = 0
    linked: int = 0
    title: bool = False
    fields: bool = False

    def beside(self, plain: int) -> bool:
        """Whether it is, on a page with so much plain text: if mostly linked, or with form fields and less than the rest of the page. Else,
        without an unlinked h1 or h2, inside an article element if it is named after what goes, and outside if it is small beside the rest."""
        own = self.size - self.linked
        if 2 * self.linked >= self.size or self.fields and own <= plain - own:
            return True
        return not self.title and (self.named if self.inside else own <= REST_SHARE * (plain - own))


_PAGE = _Open("", "", False, False)


@lru_cache(10_000)
def _names(attributes: str) -> tuple[tuple[str, ...], bool, frozenset[str], bool]:
    """(class names without digits and what parts paths, whether words surely mark it as beside the article, words that may, whether it is hidden)."""
    classes, words, sure, hidden = [], set(), False, False
    for name, a, b, c in _NAMES.findall(attributes):
        value = entities.unescape(a or b or c)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
            continue
        for one in value.split():
            own = {p.lower() for p in _PARTS.findall(one)}
            words |= own
            sure = sure or bool(own & (BESIDE_WORDS if name == "role" else SURE_WORDS))
            if name == "class":
                classes.append(re.sub(r"[\d.>]+", "", one).lower())
    article = bool(words & {"article", "articlebody"})
    return tuple(sorted({c for c in classes if c})), sure and not article, frozenset() if article else frozenset(words & BESIDE_WORDS), hidden


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a whole page in order. Unclosed, misnested and cut-off mark-up is read as far as it goes; an empty page has none."""
    out: list[Block] = []
    doubts: list[_Doubt] = []
    doubted: list[tuple[Block, tuple[int, ...]]] = []
    plain = 0
    stack = [_PAGE]
    pieces: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked, plain
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top, links = stack[-1], min(linked, len(text))
                out.append(Block(text, top.path, top.beside, linked, any(o.tag == "h1" for o in stack) and not top.beside and 2 * links < len(text)))
                if not top.beside:
                    plain += len(text) - links
                    for i in top.doubts:
                        doubts[i].size += len(text)
                        doubts[i].linked += links
                        doubts[i].title |= top.title and 2 * links < len(text)
                    if top.doubts:
                        doubted.append((out[-1], top.doubts))
            pieces.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].muted:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if stack[-1].links:
                linked += len(text)

    at, size = 0, len(page)
    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            say(page[at:])
            break
        say(page[at:mark.start()])
        at = mark.end()
        slash, tag, attributes = mark[1], mark[2], mark[3] or ""
        if tag is None:
            slash, tag = mark[4], mark[5]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SPACED:
            pieces.append(" ")
        if slash:
            found = len(stack) - 1
            while found and stack[found].tag != tag:
                found -= 1
            if tag in BLOCKS:
                flush()
                if found:
                    del stack[found:]
            elif found and not any(o.tag in BLOCKS for o in stack[found:]):
                del stack[found:]
            continue
        if tag in FIELDS:
            for i in stack[-1].doubts:
                doubts[i].fields = True
        if tag in _RAW_END:
            if not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            # an open paragraph or heading ends where the next block starts; an item ends where the next one starts
            ends = ("p",) if tag not in _ITEMS else ("p", *(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)))
            stop = _ITEMS.get(tag, ())
            i = len(stack) - 1
            while i and stack[i].tag not in CONTAINERS - {"tr", "td"} and stack[i].tag not in stop and stack[i].tag not in BESIDE:
                if stack[i].tag in ends:
                    del stack[i:]
                i -= 1
        classes, beside, doubt, hidden = _names(attributes) if attributes else ((), False, frozenset(), False)
        if tag in ("body", "html", "main", "article"):
            beside, doubt = False, doubt & APART_WORDS if tag == "article" else frozenset()
        beside = beside and tag not in HEADINGS
        above = stack[-1]
        path = above.path
        if tag in CONTAINERS:
            # articles beside each other are one, whatever their classes
            own = tag if tag in ("article", "main") else ".".join((tag, *classes))
            path = f"{path}>{own}" if path else own
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        inside = tag == "header" and any(o.tag == "article" for o in stack)
        beside = hidden or beside or tag in BESIDE and not inside
        within = above.doubts
        if doubt and not beside and tag in BLOCKS and tag not in PROSE:
            within = (*within, len(doubts))
            doubts.append(_Doubt(above.article, bool(doubt & NAMED_WORDS)))
        # a block in an inline element that is beside is so as a whole; text in one is left out of the block around it
        inline = tag not in BLOCKS
        stack.append(_Open(tag, path, above.beside or not inline and (beside or above.muted), above.links or tag == "a",
                           above.title or tag in ("h1", "h2"), within, inline and (beside or above.muted), above.article or tag in ("article", "main")))
    flush()
    gone = {i for i, d in enumerate(doubts) if d.beside(plain)}
    for block, marks in doubted:
        block.beside = not gone.isdisjoint(marks)
    return out


def containers(found: list[Block]) -> dict[str, float]:
    """What each container's path has of a page's article, 0 to 1.

    Words in plain text count for the container they stand in and all around it, linked text counts against them, and what is beside the
    article does not count. An inner container is the article if it loses next to none of this to the one around it; an article or
    main element may lose a quarter of it.
    """
    return _scores(*_weights(found))


def _weights(found: list[Block]) -> tuple[dict[str, float], int]:
    """What the blocks weigh by the path of the container they stand in, and the plain text of the page."""
    total = sum(len(b.text) - min(b.linked, len(b.text)) for b in found if not b.beside)
    sums: dict[str, float] = {}
    for b in found:
        weight = 0.0 if b.beside else len(b.text) - 1.5 * min(b.linked, len(b.text))
        sums[b.path] = sums.get(b.path, 0.0) + weight
    return sums, total


def _scores(sums: dict[str, float], total: int) -> dict[str, float]:
    scores: dict[str, float] = {}
    for path, weight in sums.items():
        while path:
            scores[path] = scores.get(path, 0.0) + weight
            path = path.rpartition(">")[0]
    out = {}
    for path, score in scores.items():
        if score > 0 and total:
            last = path.rsplit(">", 1)[-1]
            tag, *classes = last.split(".")
            words = {p for c in classes for p in _PARTS.findall(c)}
            strong = ELEMENT_BONUS if tag in ("article", "main") else NAME_BONUS if words & MAIN_WORDS else 0.0
            out[path] = min(score / total, 1.0) + strong + 0.02 * min(path.count(">"), 10)
    return out


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; an empty string if there is none or the URL is null."""
    lead = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\\\s]*)", 1)
    return F.coalesce(F.regexp_replace(lead, r"\.$", ""), F.lit(""))


def read(pages: DataFrame) -> DataFrame:
    """page_id, url, host, own (the best path of the page itself), paths (path, weight), total (plain text), names (``tag.class`` of all paths)
    and blocks (text, at: the place in paths, plain: characters that are not linked, head: whether an h1) beside which nothing is left out."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            rows = []
            for page in htmls:
                found = blocks(page)
                sums, total = _weights(found)
                scores = _scores(sums, total)
                at = {p: i for i, p in enumerate(sums)}
                steps = {step for p in sums for step in p.split(">")}
                rows.append((max(scores, key=lambda p: (scores[p], p), default=""), [{"path": p, "weight": w} for p, w in sums.items()], total,
                             sorted({f"{tag}.{c}" for tag, *classes in (step.split(".") for step in steps) for c in classes}),
                             [{"text": b.text, "at": at[b.path], "plain": len(b.text) - min(b.linked, len(b.text)), "head": b.head} for b in found if not b.beside]))
            yield pd.DataFrame(rows, columns=["own", "paths", "total", "names", "blocks"])

    kind = "own string, paths array<struct<path:string,weight:double>>, total long, names array<string>, blocks array<struct<text:string,at:int,plain:int,head:boolean>>"
    parts = F.pandas_udf(_to_frames(run), kind)
    return pages.select("page_id", "url", host(F.col("url")).alias("host"), parts(F.col("html")).alias("r")).select("page_id", "url", "host", "r.*")


def _to_frames(run):
    def wrapped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return wrapped


def _small(df: DataFrame, size: Column, shipped: int) -> DataFrame:
    """``df``, marked to be sent to every task if the sum of ``size`` is at most ``shipped``."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= shipped else df


def common_names(pages: DataFrame, *, least: float = 0.05, alone: int = 5, shipped: int = 32 << 20) -> DataFrame:
    """(host, kept): the ``tag.class`` that at least two pages and ``least`` of the pages of a host have, from (host, names).

    Hosts with fewer than ``alone`` pages are left out: all their classes count. A host keeps at most 1 / ``least`` times as many as a
    page has in the mean. Counts by (host, name) are summed before they are moved, and the lists hold what is kept only.
    """
    sizes = materialise(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= alone), "hosts")
    counts = pages.select("host", F.explode("names").alias("name")).groupBy("host", "name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    counts = counts.join(_small(sizes, F.length("host") + 64, shipped), "host").filter(F.col("n") >= F.col("pages") * least)
    lists = counts.groupBy("host").agg(F.array_sort(F.collect_list("name")).alias("kept"))
    return sizes.join(lists, "host", "left").select("host", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"))


def general(paths: Column, kept: Column) -> Column:
    """The paths without the classes that are not kept; with all if ``kept`` is null."""

    def step(s: Column) -> Column:
        parts = F.split(s, r"\.")
        return F.array_join(F.filter(parts, lambda c, i: (i == 0) | F.array_contains(kept, F.concat(parts[0], F.lit("."), c))), ".")

    cut = F.transform(paths, lambda p: F.array_join(F.transform(F.split(p["path"], ">"), step), ">"))
    return F.when(kept.isNull(), F.transform(paths, lambda p: p["path"])).otherwise(cut)


def _votes(paths: pd.Series, weights: pd.Series, totals: pd.Series) -> pd.Series:
    out = []
    for some, own, total in zip(paths, weights, totals, strict=True):
        sums: dict[str, float] = {}
        for p, w in zip(some, own, strict=True):
            sums[p] = sums.get(p, 0.0) + w
        out.append([{"path": p, "score": s} for p, s in _scores(sums, total).items()])
    return pd.Series(out)


def ballots(pages: DataFrame) -> DataFrame:
    """(host, votes): each page's (path, score), from (host, general, weights, total)."""
    cast = F.pandas_udf(_votes, "array<struct<path:string,score:double>>")
    return pages.select("host", cast("general", "weights", "total").alias("votes"))


def vote(pages: DataFrame, share: float = 0.9, *, winners: int = 5, salts: int = 64, shipped: int = 32 << 20) -> DataFrame:
    """(host, winners): the paths that the pages of each host prefer, from (host, votes).

    A page votes for each of its paths with the path's score. A host's winner is the path with the highest sum. Up to four more win whose
    mean score is at least ``share`` of the winner's, for pages of another layout. Only (host, path) sums are shuffled, summed before; a host's
    paths are ranked in ``salts`` parts first, and the first of each part among themselves, so that no task or array has them all.
    """
    cast = pages.select("host", F.explode("votes").alias("v"))
    sums = cast.groupBy("host", "v.path").agg(F.sum(F.round("v.score", 6).cast("decimal(20,6)")).alias("votes"), F.count(F.lit(1)).alias("pages"))
    sums = materialise(sums.withColumn("mean", (F.col("votes") / F.col("pages")).cast("double")), "sums")
    tops = materialise(sums.groupBy("host").agg(F.max(F.struct("votes", "mean"))["mean"].alias("top"),
                                                F.min(F.struct(-F.col("votes"), "path"))["path"].alias("first")), "tops")
    strong = sums.join(_small(tops, F.length("host") + F.length("first") + 64, shipped), "host") \
        .filter((F.col("path") == F.col("first")) | (F.col("mean") >= F.col("top") * share))
    strong = strong.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    for keys in (["host", "salt"], ["host"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "path"))
        strong = strong.withColumn("place", place).filter(F.col("place") <= winners)
    best = F.array_sort(F.collect_list(F.struct("place", "path")))
    return strong.groupBy("host").agg(F.transform(best, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, *, shipped: int = 32 << 20, share: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; null and empty pages give an empty text.

    Pages are parsed once; the blocks that are not beside the article are written, and read again with the winners of their host. If
    the counted size of all winners is at most ``shipped`` bytes they are sent to every task, else they are joined by host. Paths are voted
    for without the classes that few pages of a host have, as those named after a post; a page's own path keeps them. What stands on a
    page's own best path is read too, but for blocks that are mostly linked, unless that path leads to a winner whose blocks hold ``share`` of its
    plain text: there the host has chosen the inner container. A page without a host is read by its own best path, and one without any path by
    all its blocks. If what is read has no h1, the last one before it is read with what stands between. Repeated rows stay and vote once each.
    """
    parsed = materialise(read(pages), "blocks")
    hosted = parsed.filter(F.col("host") != "")
    kept = materialise(common_names(hosted, shipped=shipped), "names")
    names = _small(kept, F.length("host") + F.length(F.concat_ws("", "kept")) + 64, shipped)
    told = hosted.select("host", "paths", "total").join(names, "host", "left")
    # written, as Spark does not hand the lambdas of an argument to a Python function
    told = materialise(told.select("host", general(F.col("paths"), F.col("kept")).alias("general"), F.col("paths.weight").alias("weights"), "total"), "general")
    winners = materialise(vote(materialise(ballots(told), "votes"), shipped=shipped).join(kept, "host", "left"), "winners")
    size = F.length("host") + F.length(F.concat_ws("", "winners", "kept")) + 64
    joined = parsed.drop("names", "total").join(_small(winners, size, shipped), "host", "left")

    def on(paths: Column, some: Column) -> Column:
        """For each path, whether it is one of ``some`` or below."""
        return F.transform(paths, lambda p: F.exists(some, lambda w: (p == w) | p.startswith(F.concat(w, F.lit(">")))))

    def held(mark: str) -> Column:
        return F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.when(F.get(F.col(mark), b["at"]), b["plain"]).otherwise(0))

    won = F.coalesce("winners", F.array().cast("array<string>"))
    own = general(F.array(F.struct(F.col("own").alias("path"))), F.col("kept"))[0]
    joined = joined.withColumn("by_host", on(general(F.col("paths"), F.col("kept")), won)).withColumn("by_own", on(F.col("paths.path"), F.array("own")))
    inner = F.exists(won, lambda w: (w == own) | w.startswith(F.concat(own, F.lit(">")))) & (held("by_host") >= held("by_own") * share)
    joined = joined.withColumn("inner", inner)

    def read_here(b: Column) -> Column:
        added = ~F.col("inner") & F.get("by_own", b["at"]) & (2 * b["plain"] > F.length(b["text"]))
        return (F.col("own") == "") | F.get("by_host", b["at"]) | added

    joined = joined.withColumn("marks", F.transform("blocks", read_here)).withColumn("first", F.array_position("marks", True).cast("int") - 1)
    headed = F.exists(F.arrays_zip("blocks", "marks"), lambda z: z["marks"] & z["blocks"]["head"])
    start = F.array_max(F.transform("blocks", lambda b, i: F.when(b["head"] & (i < F.col("first")), i)))
    joined = joined.withColumn("start", F.when(~headed, start))
    before = lambda i: F.coalesce((i >= F.col("start")) & (i < F.col("first")), F.lit(False))
    text = F.filter("blocks", lambda b, i: F.get("marks", i) | before(i))
    joined = joined.withColumn("text", F.array_join(F.transform(text, lambda b: b["text"]), "\n"))
    return joined.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
