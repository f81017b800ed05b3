"""HTML extraction with a site style tree.

The DOMs of all pages of one host are merged into one tree.  A node of the tree stands for elements with the same path of
tags and classes; elements deeper than ``TREE_DEPTH`` belong to their ancestor of that depth.  With m pages
that show a node, l different layouts of children, and damping g:

* its presentation importance is the entropy of its layouts over the pages to the base m (1 if m is 1);
* its content importance is one less the mean entropy, to the base m, of its own blocks of text over the pages: a text
  on all pages says nothing, a text on one page is its content;
* its composite importance is (1 - g^l) x presentation + g^l x the mean composite importance of what it
  shows, which are its child nodes and, by their share, its own blocks.

The recursion is linear, so it unrolls into a sum over all descendants, weighted by shares and dampings along the path:
two joins of (node, ancestor) pairs, whatever the depth.  A node is noise if it and all its descendants
are below the threshold and enough pages show it; the branches of noise are removed from each page.  All that is shown is in the tree.

Elements whose tag, role or class says that they are no article (menus, footers, adverts, forms, comments and so
on) are suspects.  That is a prior, which lowers their importance below the threshold on each page, since such texts also vary between
pages; it does not apply to a suspect that holds a main element, an article longer than all text outside suspects, or most of the page's text.

Statistics are partial aggregates over (host, node, feature), so a host with a third of all
pages is added up in every task.  Where a host's short list of noise is not broadcast, a hot host's pages are dealt to salted keys.

Defined results: null and empty pages have the text ``""``; a page without url has the host
``""``; a page of which the tree would leave nothing keeps its blocks; where a main element holds text that is left, only
that counts; a tag that never ends is not shown; an end tag that is implied is looked for among the innermost
``LOOK_BACK`` open elements.  Time and memory grow with the length of a page.  White space in a block becomes one space, blocks are joined by one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Set

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..staging import stage
from .common import OWN, join_salted

THRESHOLD, MIN_PAGES, DAMPING = 0.3, 8, 0.9
#: How many open elements an end that may be implied looks back over, and the levels of the tree.
LOOK_BACK, TREE_DEPTH = 512, 32
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown as text of the page.
UNSEEN = frozenset("script style noscript template select textarea iframe svg head object embed canvas audio video noframes noembed xmp title".split())
#: Suspects by tag, by role, and by words of class or id; words behind a MODIFIER tell of a state and not of the element.
TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup comment comments commentlist respond reply replies disqus "
    "related recommended recommendations share sharing social widget widgets toolbar pagination pager login search masthead topbar copyright cookiebar skyscraper leaderboard aside rail trending adsense teaser teasers discussion discussions paywall".split()
)
#: What may stand beside such a word in one name, as in "site-footer"; any other part, as in "share-price", tells of something else.
NEUTRAL = frozenset(
    "site page global top bottom left right primary secondary main inner outer box bar area list item items section block wrapper wrap container content body row col column group unit slot button "
    "buttons link links icon icons text label title post posts entry article articles story stories user reader blog web x px the my on in google js id module panel region zone small large mobile desktop card news info warning danger success dark light sticky fixed fb facebook wall thread".split()
)
#: Articles of these are no main text.
ASIDES = frozenset("comment comments teaser teasers related recommended promo promos sponsored".split())
OF_TEXT = frozenset("post entry article story content text".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MODIFIER = re.compile(r"(?:no|not|has|with|without|is|show|hide)-")
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tbody",)}
_SCOPES = frozenset("ul ol dl table select div article section main body".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}


def _words(value: str) -> set[str]:
    """The parts of class names or ids that tell of suspects: of those names whose other parts tell of nothing else."""
    found: set[str] = set()
    for name in _CAMEL.sub("-", value).lower().split():
        parts = {w for w in re.split(r"[^a-z]+", name) if w}
        if not MODIFIER.match(name) and all(w in WORDS or w in NEUTRAL or w == "header" for w in parts):
            found |= parts & WORDS
            if "header" in parts and not parts & OF_TEXT:
                found.add("header")
    return found


def _suspect(tag: str, given: dict[str, str], in_article: bool) -> bool:
    if tag in TAGS:
        return True
    if tag in ("html", "body", "article", "main"):
        return bool(ASIDES & _words(given.get("class", ""))) if tag == "article" else False
    if tag == "header" and not in_article:
        return True
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True
    words = _words(f"{given.get('class', '')} {given.get('id', '')}")
    return bool(words & WORDS) or ("header" in words and not in_article)


def _label(tag: str, given: dict[str, str]) -> str:
    words = [w for w in sorted(set(re.split(r"\s+", given.get("class", "").lower()))) if w]
    ident = re.sub(r"\d+", "", given.get("id", "").lower())
    return re.sub(r"[/\s]", "_", tag + "".join("." + w for w in words) + ("#" + ident if ident else ""))


def _child(node: int, label: str) -> int:
    """The tree node of an element by its parent's node and its label."""
    return xxhash.xxh64_intdigest(label, node & (1 << 64) - 1) - (1 << 63)


class Page:
    """One page in one pass: ``blocks`` with (node, text, suspect, article, main, noise), and the nodes that are shown.

    ``up`` has the path of each node, ``layout`` the children in order of each (None: a block of its own).
    """

    def __init__(self, page: str, noise: Set[int] = frozenset()):
        self.blocks: list[tuple[int, str, int, int, bool, bool]] = []
        self.up: dict[int, tuple[int, ...]] = {0: (0,)}
        self.layout: defaultdict[int, list[int | None]] = defaultdict(list)
        self.outer, self.spared, self.articles = [0], set(), {}  # suspect around each suspect
        self.number, self.noise, self.pending = 0, noise, []
        #: tag, node, unseen, in an article or main, suspect around, outermost article, in a main, in noise
        self.stack = [("", 0, False, False, 0, 0, False, False)]
        self.opened: Counter[str] = Counter()
        self._read(page)

    def _flush(self) -> None:
        if self.pending:
            text = " ".join(html.unescape("".join(self.pending)).split())
            self.pending.clear()
            if text:
                _, node, _, _, suspect, article, main, noise = self.stack[-1]
                self.blocks.append((node, text, suspect, article, main, noise))
                self.layout[node].append(None)

    def _pop(self, at: int) -> None:
        stack = self.stack
        if any(s[0] not in INLINE for s in stack[at:]) or stack[-1][4] != stack[at - 1][4]:
            self._flush()
        self.opened.subtract(s[0] for s in stack[at:])
        del stack[at:]

    def _innermost(self, names: tuple[str, ...], until: Set[str]) -> int:
        if any(self.opened[n] for n in names):
            for k in range(len(self.stack) - 1, max(len(self.stack) - 1 - LOOK_BACK, 0), -1):
                if self.stack[k][0] in names:
                    return k
                if self.stack[k][0] in until:
                    break
        return 0

    def _read(self, page: str) -> None:
        at, size, last, lower, stack = 0, len(page), page.rfind(">"), None, self.stack
        while at < size:
            mark = _TAG.search(page, at) if at <= last else _OPEN.search(page, at)
            end = mark.start() if mark else size
            if end > at and not stack[-1][2]:
                self.pending.append(page[at:end])
            if not mark or mark.re is _OPEN:
                break  # no mark, or one that never ends
            at = mark.end()
            tag = mark[2] or mark[5]
            if not tag:
                continue
            tag = tag.lower()
            if mark[1] or mark[4]:
                self._close(tag)
            else:
                self._open(tag, (mark[3] if mark[2] else mark[6]) or "")
                if tag in RAW:
                    if lower is None:
                        lower = page.lower()
                        if len(lower) != size:  # letters whose lower case is longer
                            lower = re.sub("[A-Z]", lambda m: m[0].lower(), page)
                    close = lower.find(f"</{tag}", at)
                    at = close if close >= 0 else size
        self._flush()

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.pending.append(" ")
        elif self.opened[tag]:
            stack = self.stack
            far = max(len(stack) - 1 - LOOK_BACK, 0) if tag in INLINE else 0
            k = next((k for k in range(len(stack) - 1, far, -1) if stack[k][0] == tag or (tag in INLINE and stack[k][0] not in INLINE)), 0)
            if k and stack[k][0] == tag:
                self._pop(k)

    def _open(self, tag: str, raw: str) -> None:
        stack = self.stack
        if tag in _CLOSES_P and (k := self._innermost(("p",), _SCOPES - {"p"})):
            self._pop(k)
        if tag in _SELF and (k := self._innermost(_SELF[tag], _SCOPES)):
            self._pop(k)
        if tag in VOID:
            if tag == "br" and not stack[-1][2]:
                self.pending.append(" ")
            elif tag == "hr":
                self._flush()
            return
        given = _attributes(raw) if raw.strip(" /\n\t") else {}
        _, node, unseen, in_article, around, article, main, noise = stack[-1]
        suspect = not unseen and tag not in UNSEEN and _suspect(tag, given, in_article)
        if suspect:
            self.outer.append(around)
            around = len(self.outer) - 1
        if tag == "main":
            main = True
            self.spared.add(around)
        if tag == "article" and not article and not suspect:
            self.number += 1
            article = self.number
            self.articles[article] = around
        unseen = unseen or tag in UNSEEN
        if tag not in INLINE or suspect:
            self._flush()
        if tag not in INLINE and not unseen and len(self.up[node]) <= TREE_DEPTH:
            child = _child(node, _label(tag, given))
            self.up.setdefault(child, (*self.up[node], child))
            self.layout[node].append(child)
            node, noise = child, noise or child in self.noise
        stack.append((tag, node, unseen, in_article or tag in ("article", "main"), around, article, main, noise))
        self.opened[tag] += 1

    def removed_by_prior(self) -> list[bool]:
        """For each suspect (0: none), whether it or one around it is removed."""
        held, told, total, free = Counter(), Counter(), 0, 0
        for _, text, suspect, article, _, _ in self.blocks:
            told[article] += len(text)
            held[suspect] += len(text)
        total, free = sum(held.values()), held[0]
        spared = set(self.spared)
        spared.update(around for k, around in self.articles.items() if told[k] > free)
        for k in range(len(self.outer) - 1, 0, -1):
            if 2 * held[k] > total or k in spared:
                spared.update((k, self.outer[k]))
            held[self.outer[k]] += held[k]
        gone = [False]
        for k in range(1, len(self.outer)):
            gone.append(k not in spared or gone[self.outer[k]])
        return gone

    def text(self) -> str:
        """The main text."""
        gone = self.removed_by_prior()
        found = [b for b in self.blocks if not gone[b[2]]]
        kept = [b for b in found if not b[5]] or found
        main = [b for b in kept if b[4]]
        return " ".join(b[1] for b in main or kept)


def main_text(page: str, noise: Set[int] = frozenset()) -> str:
    """The text of the page without suspects and without branches of noise."""
    return Page(page, noise).text()


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_STATS = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("weight", pa.float64()), ("up", pa.list_(pa.int64()))]))
_STATS_SQL = "array<struct<node:bigint,kind:int,feature:bigint,weight:double,up:array<bigint>>>"


def page_stats(page: str) -> list[tuple]:
    """(node, kind, feature, weight, up): nodes with their share of the parent (kind 0), their texts (1), layouts (2), and own blocks' share (3)."""
    seen = Page(page)
    shares: dict[int, float] = defaultdict(float)
    rows: list[tuple] = []
    for node, children in seen.layout.items():
        runs = [a for a, b in zip(children, [0, *children], strict=False) if a != b]
        rows.append((node, 2, xxhash.xxh64_intdigest(str(runs)) - (1 << 63), 0.0, None))
        own = children.count(None)
        if own:
            rows.append((node, 3, 0, own / len(children), None))
        for child, n in Counter(children).items():
            if child is not None:
                shares[child] += n / len(children)
    rows += [(node, 0, 0, shares[node], list(up)) for node, up in seen.up.items()]
    texts = {(node, xxhash.xxh64_intdigest(text) - (1 << 63)) for node, text, *_ in seen.blocks}
    return rows + [(node, 1, feature, 0.0, None) for node, feature in sorted(texts)]


def style_tree(pages: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, node, pages, importance, most) of every node of every host's tree; ``most`` is the greatest importance in its branch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [f.name for f in _STATS.value_type]
        for batch in batches:
            yield pa.array([[dict(zip(names, r, strict=True)) for r in page_stats(t or "")] for t in batch.to_pylist()], _STATS)

    stats = arrow_udf(run, _STATS_SQL, ArrowUDFType.SCALAR_ITER)
    rows = pages.select(host(F.col("url")).alias("host"), F.explode(stats("html")).alias("s")).select("host", "s.*")
    counted = rows.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.first("up", ignorenulls=True).alias("up"))
    n, kind = F.col("n"), F.col("kind")

    def total(k: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind == k, value)), F.lit(0.0))

    nodes = counted.groupBy("host", "node").agg(
        total(0, n).alias("m"), total(0, F.col("w")).alias("shown"), F.first("up", ignorenulls=True).alias("up"),
        total(1, n).alias("texts"), total(1, n * F.ln(n)).alias("text_logs"),
        F.greatest(F.count_if(kind == 2), F.lit(1)).alias("layouts"), total(2, n * F.ln(n)).alias("layout_logs"), total(2, n).alias("laid"),
        total(3, F.col("w")).alias("own_blocks"),
    )
    m, base, fade = F.col("m"), F.ln("m"), F.pow(F.lit(damping), F.col("layouts"))
    content = F.when(F.col("texts") == 0, 0.0).when(m > 1, 1 - F.col("text_logs") / F.col("texts") / base).otherwise(1.0)
    look = F.when(m <= 1, 1.0).when(F.col("laid") > 0, (F.ln("laid") - F.col("layout_logs") / F.col("laid")) / base).otherwise(0.0)
    nodes = stage(
        nodes.select("host", "node", "up", "m", "shown", F.ln(fade).alias("fade"), ((1 - fade) * look + fade * F.col("own_blocks") / m * content).alias("own")), "style_nodes"
    )
    above = nodes.select("host", F.col("node").alias("parent"), F.col("m").alias("pm"))
    parent = F.try_element_at("up", F.lit(-2))
    steps = nodes.withColumn("parent", parent).join(above, ["host", "parent"], "left").withColumn("step", F.coalesce(F.ln(F.col("shown") / F.col("pm")), F.lit(0.0)))
    # along each path: the logarithm of what weight a node has in the root
    pairs = nodes.select("host", "node", "own", F.explode("up").alias("a"))
    along = pairs.join(steps.select("host", F.col("node").alias("a"), "step", "fade"), ["host", "a"])
    depth = along.groupBy("host", "node").agg(F.sum(F.col("step") + F.when(F.col("a") == F.col("node"), 0.0).otherwise(F.col("fade"))).alias("log_weight"))
    weighed = stage(nodes.join(depth, ["host", "node"]).select("host", "node", "up", "own", "log_weight", F.col("m").cast("long").alias("pages")), "style_weights")
    top = weighed.select("host", F.col("node").alias("a"), F.col("log_weight").alias("top"), "pages")
    pairs = weighed.select("host", "log_weight", "own", F.explode("up").alias("a")).join(top, ["host", "a"])
    part = F.exp(F.col("log_weight") - F.col("top")) * F.col("own")
    known = stage(pairs.groupBy("host", "a").agg(F.sum(part).alias("importance"), F.first("pages").alias("pages")).withColumnRenamed("a", "node"), "style_importance")
    most = weighed.select("host", "node", F.explode("up").alias("a")).join(known.select("host", "node", "importance"), ["host", "node"]).groupBy("host", "a").agg(F.max("importance").alias("most"))
    return known.join(most.withColumnRenamed("a", "node"), ["host", "node"]).select("host", "node", "pages", "importance", "most")


def low_branches(tree: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, low, n): the nodes of noise, and the pages of the host."""
    noise = (F.col("most") < threshold) & (F.col("pages") >= min_pages) & (F.col("node") != 0)
    found = tree.groupBy("host").agg(F.sort_array(F.collect_set(F.when(noise, F.col("node")))).alias("low"), F.max("pages").alias("n"))
    return found.where(F.size("low") > 0)


def extract_text(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (with url and html) with ``text``; a column of that name is replaced."""
    low = stage(low_branches(style_tree(pages.select("url", "html")), threshold, min_pages), "low_branches")
    low = low.select(F.col("host").alias(OWN + "host"), F.col("low").alias(OWN + "low"), "n")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for page, nodes in batches:
            yield pa.array([main_text(p or "", frozenset(q or ())) for p, q in zip(page.to_pylist(), nodes.to_pylist(), strict=True)], pa.string())

    text = arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)
    joined = join_salted(pages.withColumn(OWN + "host", host(F.col("url"))), low, [OWN + "host"], "n", F.col("url"), "left")
    return joined.withColumn("text", text("html", OWN + "low")).drop(OWN + "host", OWN + "low")


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and its code points."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
