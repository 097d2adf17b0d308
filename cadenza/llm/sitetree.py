"""Main text of web pages by a site style tree.

The pages of a host, whole, are merged into one tree: a node is a path of block elements with their classes, and it knows how often it
has which presentation (the sequence of its children) and which content (its own text). The importance of a node is the entropy that
its contents have over the pages, as a share of the greatest possible: text that differs from page to page is the site's matter, text
that returns is its frame. Varied presentation adds a little. The importance of a branch is that of its nodes, each weighed with its
part of the branch's characters, which is the same from the leaves up. Branches of low importance are removed from each page.

What elements mean is a prior, a factor of their importance. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments have `FRAME`, less than any threshold, by tag, role, or a word of their class or id. Of hyphenated names all parts
must say so, and none of `NEGATING` stand before them. Class words never mark an article, and where they alone would take every
article, or all prose of a page, they don't count. Where a page has an article (or else a main element) with text, what lies outside
has `FRAME` too. So statistics alone can only remove more: inside an article a branch goes if nearly every page of many has it, and
never if less than `LEAST_KEPT` of the text would stay.

The tree's statistics are counts per host, path and content over the host's different pages: copies count once. They are summed again;
a host with a third of all pages is no group that one task must hold. The low branches of each host are joined to its pages; few are
sent to all tasks, many are met by a shuffle whose large partitions are split.

Edge cases: null, empty and broken html give what text there is, or the empty string; pages without a host, and hosts with few pages,
are judged by meaning alone; a page that would lose everything to statistics keeps what meaning leaves;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table, written

#: Least importance outside and inside articles, and the pages that a node must be in to be judged there.
LEAST, PAGES, LEAST_IN_ARTICLE, PAGES_IN_ARTICLE = 0.3, 3, 0.1, 10
#: What presentation adds to importance, and the prior of what is frame by its meaning.
PRESENTATION, FRAME = 0.1, 0.2
#: Share of an article's characters that statistics must leave, or else they take nothing.
LEAST_KEPT = 1 / 3
DEPTH = 16

# HTML element names and the words of class and id attributes that mark the frame of a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe li main menu nav noscript ol option p pre script search section select style summary"
    " svg table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
FRAME_TAGS = frozenset("aside button dialog footer form head header iframe menu nav noscript script search select style svg template textarea title".split())
FRAME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer"
    " disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager"
    " pagination paywall popup promo promotion reader-comments related reply replies respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe taboola tags toolbar topbar widget".split()
)
#: First parts of names that only say that a frame is there or not, and parts that say where a frame stands or what shape it has.
NEGATING = frozenset("has with no non not without tag category cat format type status is".split())
PLACES = frozenset(
    "a aria article b bar block blog body bottom box btn button buttons col column container content entry fixed global group holder icons inner item items"
    " js left links list lower main mid middle mobile outer overlay page panel post posts primary reader right row secondary section site slot sticky"
    " sub text the top unit upper user wrap wrapper".split()
)
#: Elements that hold prose, and words that make a text of others prose too.
PROSE, PROSE_WORDS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd".split()), 10
ARTICLE, MAIN = "article", "main"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|\Z)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}


class Node:
    """``marked``: 2 by class words, 1 by those of a branch around the article that it is in, else 0."""

    __slots__ = ("tag", "path", "frame", "marked", "inside", "children")

    def __init__(self, tag: str, path: str, frame: bool, marked: int, inside: str):
        self.tag, self.path, self.frame, self.marked, self.inside, self.children = tag, path, frame, marked, inside, []


def _is_frame(tag: str, attributes: dict[str, str]) -> bool:
    """By tag, role, or being hidden."""
    return tag in FRAME_TAGS or attributes.get("role", "").lower() in FRAME_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"


def _is_marked(tag: str, attributes: dict[str, str]) -> bool:
    """By class words."""
    if tag in ("html", "body", MAIN):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        name = _CAMEL.sub("-", name).lower().replace("_", "-")
        parts = _WORDS.findall(name)
        if name in FRAME_WORDS or parts and parts[0] not in NEGATING and any(p in FRAME_WORDS for p in parts) and all(p in FRAME_WORDS or p in PLACES for p in parts):
            return True
    return False


def blocks(page: str) -> Iterator[tuple[Node, str]]:
    """(node, raw text) in page order; a node with children's texts comes once for each run of text of its own."""
    root = Node("", "", False, 0, "")
    stack, parts, at = [root], [], 0

    def flush():
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts = []
            if text:
                return [(stack[-1], text)]
        return []

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            continue
        yield from flush()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in VOID:
            continue
        closes = _CLOSES.get(tag)
        if closes and stack[-1].tag in closes:
            while stack[-1].tag in closes:
                stack.pop()
        elif stack[-1].tag == "p":  # a paragraph holds no block
            stack.pop()
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        parent = stack[-1]
        label = tag + "".join(f".{_DIGITS.sub('#', w).replace('/', '|')}" for w in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()[:4])
        path = f"{parent.path}/{label}" if len(stack) <= DEPTH else parent.path
        inside = tag if tag in (ARTICLE, MAIN) and parent.inside != ARTICLE else MAIN if attributes.get("role") == "main" and not parent.inside else parent.inside
        outermost = tag == ARTICLE and parent.inside != ARTICLE
        marked = min(parent.marked, 1) if outermost else 2 if _is_marked(tag, attributes) else parent.marked
        node = Node(tag, path, parent.frame or _is_frame(tag, attributes), marked, inside)
        parent.children.append(label)
        if m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:  # what is inside isn't markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        parts.append(page[at:])
    yield from flush()


def _has_prose(found: list[tuple[Node, str]]) -> bool:
    return any(node.tag in PROSE for node, _ in found) or sum(len(text.split()) for _, text in found) >= PROSE_WORDS


def by_meaning(page: str) -> list[tuple[Node, str, bool]]:
    """All texts of a page, and whether their elements mean that they are no frame."""
    whole = list(blocks(page))
    kept = {id(x) for x in _no_frame(whole)}
    return [(*x, id(x) in kept) for x in whole]


def _no_frame(whole: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The texts that no frame holds, of the articles if these have text, else of the main element, else of the page."""
    found = [x for x in whole if not x[0].frame]
    articles = [x for x in found if x[0].inside == ARTICLE]
    for level in (0, 1):
        if own := [x for x in articles if x[0].marked <= level]:
            return own
    if _has_prose(articles):
        return articles
    plain = [x for x in found if not x[0].marked]
    if not plain and _has_prose(found):
        plain = found
    return [x for x in plain if x[0].inside == MAIN] or plain


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def tree(pages: DataFrame) -> DataFrame:
    """(site, html) to the site's nodes: site, path, kept (by meaning), article, pages, characters, content and style (entropies, from 0 to 1)."""

    def nodes(batches):
        for batch in batches:
            rows: list[tuple] = []
            for site, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[tuple, list] = {}
                for node, text, kept in by_meaning(page):
                    own.setdefault((node.path, kept), [node, []])[1].append(text)
                made = [(path, kept, node.inside == ARTICLE, sum(map(len, texts)), _hash("/".join(node.children)), _hash("\n".join(texts))) for (path, kept), (node, texts) in own.items()]
                copy = _hash(repr(made))
                rows += [(site, *row, copy) for row in made]
            names = ["site", "path", "kept", "article", "chars", "style", "content", "copy"]
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    made = pages.where("site != ''").mapInArrow(nodes, "site string, path string, kept boolean, article boolean, chars long, style long, content long, copy long")
    made = made.distinct()  # a page counts once, however many copies there are
    key = ["site", "path", "kept", "article"]

    def spread(feature: str) -> DataFrame:
        """The entropy over the pages as a share of the greatest: 0 where all pages have the same, 1 where each has its own."""
        counts = made.groupBy(*key, feature).agg(F.count("*").alias("t"), F.sum("chars").alias("chars"))
        entropy = 1 - F.sum(F.col("t") * F.log("t")) / (F.sum("t") * F.log(F.greatest(F.sum("t"), F.lit(2))))
        return counts.groupBy(*key).agg(F.sum("t").alias("pages"), F.sum("chars").alias("chars"), entropy.alias(feature))

    return spread("content").join(spread("style").drop("pages", "chars"), key)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def branches(nodes: DataFrame) -> DataFrame:
    """(site, path, kept, article, pages, importance) of every branch: of its nodes, weighed by their characters, prior times entropies."""
    own = F.col("content") + PRESENTATION * F.col("style") * (1 - F.col("content"))
    rated = nodes.withColumn("importance", own * F.when(F.col("kept"), 1.0).otherwise(FRAME))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))  # a path begins with "/"
    each = rated.select("site", "kept", "article", "pages", "chars", "importance", F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array("path"))).alias("path"))
    weight = F.greatest(F.sum("chars"), F.lit(1))
    return each.groupBy("site", "path", "kept", "article").agg(F.max("pages").alias("pages"), (F.sum(F.col("importance") * F.col("chars")) / weight).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(site, html) to (site, paths): the branches of low importance in enough pages, of what meaning alone would keep.

    Others have `FRAME` as their prior, and no entropy can raise them over the threshold: they need no look-up.
    """
    judged = branches(tree(pages)).where("kept")
    low = F.when(F.col("article"), (F.col("importance") < LEAST_IN_ARTICLE) & (F.col("pages") >= PAGES_IN_ARTICLE)).otherwise((F.col("importance") < LEAST) & (F.col("pages") >= PAGES))
    return judged.where(low).groupBy("site").agg(F.collect_set("path").alias("paths"))


def main_text(page: str, low: list[str] | None) -> str:
    kept = [(node, text) for node, text, stays in by_meaning(page) if stays]
    if low:
        gone = set(low)
        rest = [x for x in kept if not _within(x[0].path, gone)]
        least = LEAST_KEPT * sum(len(text) for node, text in kept if node.inside == ARTICLE)
        kept = rest if rest and sum(len(text) for _, text in rest) >= least else kept
    return " ".join(text for _, text in kept)


def _within(path: str, gone: set[str]) -> bool:
    """Is a node in one of the branches?"""
    while path and path not in gone:
        path = path.rpartition("/")[0]
    return bool(path)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    chosen = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host(F.col(url_col)).alias("site"))
    low = written(low_branches(chosen.select("site", "html")))  # its size is then known
    joined = chosen.join(low, "site", "left").select("key", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            texts = [main_text(page, paths) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [joined.schema[c].dataType.simpleString() for c in ("key", "url")]
    return joined.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op7_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
