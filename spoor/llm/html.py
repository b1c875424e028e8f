"""HTML main text by consensus host paths (operator 7)."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Elements of the HTML standard by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object textarea select button title head canvas audio video".split())
ASIDE = set("nav header footer aside form dialog menu".split())
BLOCK = set("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("article main section div body td blockquote".split())
#: Class and id words of what isn't the article.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion related reply replies respond sidebar share sharing signup social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
#: A comment, a declaration, a tag with its attributes; last a tag of which a quote is never closed, which ends at the next `>`.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
#: Opening one of these ends an open one of the same kind, whose end tag may be left out.
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
_ENDS |= {t: {"p"} for t in BLOCK - set(_ENDS) - {"br", "body", "html"}}
_SCOPE = set("article section div main body td th table ul ol dl blockquote aside nav header footer form".split())


@dataclass
class Node:
    tag: str
    path: int  # number of the path from the body, among the page's
    aside: bool
    first: int  # its blocks are those from first to before last
    last: int = -1


@dataclass
class Page:
    blocks: list[tuple[str, int]]  # text, characters inside links
    containers: list[Node]
    paths: list[tuple[int, str, int]] = field(default_factory=list)  # by number: the parent's number, the own step, the depth
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)

    def number(self, parent: int, step: str) -> int:
        key = (parent, step)
        if key not in self.numbers:
            self.numbers[key] = len(self.paths)
            self.paths.append((parent, step, self.paths[parent][2] + 1 if parent >= 0 else 0))
        return self.numbers[key]

    def spelled(self, number: int) -> str:
        """The generalised tag-class path from the body."""
        steps: list[str] = []
        while number >= 0:
            number, step, _ = self.paths[number]
            steps.append(step)
        return "/".join(reversed(steps))

    def found(self, path: str) -> int | None:
        """The number of a spelled path, if the page has it."""
        at: int | None = -1
        for step in path.split("/"):
            at = self.numbers.get((at, step))
            if at is None:
                return None
        return at


def _step(tag: str, names: list[str]) -> str:
    """A tag with its classes, digits generalised: `div.post-body`, `div.post-#`."""
    kept = sorted({re.sub(r"\d+", "#", n).replace("/", "|") for n in names})
    return ".".join([tag, *kept])


def parse(text: str) -> Page:
    """The text blocks of a page in order, with the containers they lie in. Unclosed and stray tags are put up with.

    Character references are decoded, in votes too, as scores count characters.
    """
    page = Page([], [])
    root = Node("body", page.number(-1, "body"), False, 0)
    stack, containers, blocks = [root], page.containers, page.blocks
    containers.append(root)
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0
    at, n = 0, len(text)

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if joined and not stack[-1].aside:
            blocks.append((joined, linked))
        linked = 0

    def close(k: int) -> None:
        """End the open elements from the k-th on; what they say has been flushed."""
        for node in stack[k:]:
            node.last = len(blocks)
            open_tags[node.tag] -= 1
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].aside:
            raw = entities.unescape(raw)
            parts.append(raw)
            if links:
                linked += len(raw)

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        slash, name, inside = m.groups()[:3] if m[2] else m.groups()[3:]
        tag = name.lower() if name else ""
        if not tag:
            continue
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK or tag in ASIDE:
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if tag in RAW and tag != "head":
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else n if tag in ("script", "style", "textarea", "title", "template") else at
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(text, at)
            at = at if end is None else end.end() if end[0].startswith("</") else end.start()
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK or tag in ASIDE:
            flush()
        if tag in VOID or inside.rstrip().endswith("/"):
            continue
        for k in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in _ENDS.get(tag, ())) else ():
            if stack[k].tag in _ENDS[tag]:
                close(k)
                break
            if stack[k].tag in _SCOPE:
                break
        if tag in BLOCK or tag in ASIDE:
            attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(inside)} if inside.strip() else {}
            names = attributes.get("class", "").lower().split()
            words = {w for x in (*names, attributes.get("id", "").lower(), attributes.get("role", "").lower()) for w in _WORDS.split(x)}
            article = tag in ("article", "main", "body", "html")
            hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "")
            off = stack[-1].aside or hidden or (not article and (tag in ASIDE or bool(words & BOILERPLATE)))
            if tag == "header" and open_tags["article"] and not words & BOILERPLATE and not stack[-1].aside:
                off = False
            if tag in ("html", "body"):
                continue
            node = Node(tag, page.number(stack[-1].path, _step(tag, names)), off, len(blocks))
            stack.append(node)
            open_tags[tag] += 1
            if tag in CONTAINER and not off:
                containers.append(node)
    flush()
    close(0)
    return page


_VALUE = {"article": 1.5, "main": 1.4, "section": 1.1, "div": 1.0, "td": 0.9, "blockquote": 0.6, "body": 0.5}


def scores(page: Page) -> dict[int, float]:
    """Per number of a container's path: the characters of its blocks that aren't links, by what share of the page's it
    holds, by its tag, less for blocks that are mostly links. Equal paths add up."""
    sizes = list(accumulate((len(t) for t, _ in page.blocks), initial=0))
    links = list(accumulate((min(x, len(t)) for t, x in page.blocks), initial=0))
    total = sizes[-1] or 1
    out: dict[int, float] = {}
    for node in page.containers:
        size = sizes[node.last] - sizes[node.first]
        plain = size - (links[node.last] - links[node.first])
        if size:
            out[node.path] = out.get(node.path, 0.0) + plain / total * plain / size * _VALUE.get(node.tag, 1.0)
    return out


def _best(page: Page) -> int | None:
    found = scores(page)
    if not found:
        return None
    rank = {n: (round(s, 9), page.paths[n][2]) for n, s in found.items()}
    most = max(rank.values())
    return min((n for n, r in rank.items() if r == most), key=page.spelled)


def best_path(page: Page) -> str | None:
    """A page's vote: its best path; of equal ones the longest, then the first in order."""
    best = _best(page)
    return None if best is None else page.spelled(best)


def main_text(page: Page, paths: list[str]) -> str:
    """The blocks under the first of the paths that the page has, else under its own best; joined by one space."""
    full = {node.path for node in page.containers if node.last > node.first}
    path = next((n for p in paths if (n := page.found(p)) in full), None)
    path = _best(page) if path is None else path
    if path is None:
        return ""
    keep, at = [], 0
    for node in page.containers:  # in page order: one inside another with the same path adds nothing
        if node.path == path:
            keep += page.blocks[max(at, node.first) : node.last]
            at = max(at, node.last)
    return " ".join(t for t, _ in keep)


def host_of(url):
    """The host of a URL column, lower-cased; null and odd URLs give an empty one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


#: A host's votes follow only a path that at least this part of its pages votes for.
QUORUM = 0.5


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every row: its main text by the path that its host's pages agree on.

    First each page's containers are scored and its best path counted as a vote; votes are
    summed by host and path in Spark, and each host keeps its best path if half its pages voted
    for it. Then every page is extracted again with its host's path, or its own best one where the
    host has none or the page lacks it. Pages without a host vote for themselves only. Null and
    empty html gives an empty text; an empty table gives an empty result. Repeated rows each keep their row
    and their vote. Pages may have any length and depth: work grows with their length. The winning paths, one short row
    a host, meet the pages in a join; a host with many pages is split by a salt.
    """
    slim = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    votes = shared.map_texts(slim.where("host <> ''"), "host", "html", "path string", lambda texts: ([best_path(parse(t)) if t else None for t in texts],))
    tally = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    total = F.expr("sum(n) over (partition by host)")
    first = F.expr("row_number() over (partition by host order by n desc, path)")
    winners = tally.withColumns({"total": total, "k": first}).where((F.col("k") == 1) & (F.col("n") >= QUORUM * F.col("total"))).select("host", "path")
    winners = shared.cut(winners, "host-paths")
    salts = 16
    spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, ["host", "salt"], "left")
    packed = joined.select("page_id", "url", F.struct("html", "path").alias("page"))

    def work(pages):
        return ([main_text(parse(p["html"]), [p["path"]] if p["path"] else []) if p["html"] else "" for p in pages],)

    both = packed.select(F.struct("page_id", "url").alias("key"), "page")
    return shared.map_texts(both, "key", "page", "text string", work).select("key.page_id", "key.url", "text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its number of characters."""
    found = extract(shared.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
