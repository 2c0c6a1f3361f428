"""The main text of web pages: flat text blocks, described by themselves and their neighbours, kept or dropped by a decision tree.

A page is cut into blocks at its block elements. Spark puts each block beside its neighbours, and a
tree that Spark ML fits to the blocks of SAMPLES, a small labelled table, says which are text; the
tree is a column expression, so pages stay rows of their own and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, freed

#: Elements between which text does not run on, fixed by HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag; elements whose content is no text of the page, up to their end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe svg math textarea select object audio video canvas title head".split())
#: Of these only text follows, whatever looks like a tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Open elements that the start of an element ends, as far as the given container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and roles of an article, and of what stands around it.
ARTICLE, ARTICLE_ROLES = frozenset({"article", "main"}), frozenset({"main", "article"})
AROUND, AROUND_ROLES = frozenset("nav aside footer menu dialog button".split()), frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: First words of class names and ids of what stands around an article, whole parts of such names, and parts of an article's names.
AROUND_STARTS = tuple("advert banner breadcrumb comment consent cookie copyright disqus gdpr login masthead navbar navigation newsletter notice notif pagination popup promo recommend related respond sharing sidebar signup skip social sponsor subscribe teaser toolbar topbar widget".split())
AROUND_PARTS = frozenset("ad ads adv aside alert dfp foot footer header head legal menu modal nav pager reply replies share side tags trending".split())
ARTICLE_PARTS = frozenset("article body content entry main post story text".split())
#: Of an article's own names these alone count against it: reader comments and pointers to other articles are articles, too.
NOT_ITSELF = ("comment", "teaser", "related", "recommend", "promo", "sponsor", "advert")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/]|$)""", re.I)
_NO_PART = re.compile(r"[^a-z]+")
BLOCK = "array<struct<text: string, words: int, linked: int, article: int, around: int, named: int, heading: int>>"


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Of an element: whether it is an article, stands around one for sure, does so by its names, or is named as an article."""
    article, around, by_name, named = tag in ARTICLE, tag in AROUND, tag in ("form", "header"), False
    if attributes and tag not in ("html", "body"):
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                article, around = article or value in ARTICLE_ROLES, around or value in AROUND_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                around = True
            elif name in ("class", "id"):
                parts = [p for p in _NO_PART.split(value) if p]
                if article:
                    around = around or any(p.startswith(NOT_ITSELF) for p in parts)
                else:
                    by_name = by_name or any(p in AROUND_PARTS or p.startswith(AROUND_STARTS) for p in parts)
                    named = named or any(p in ARTICLE_PARTS for p in parts)
    return article, around, by_name, named and not by_name


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """The flat text blocks of a page in order: text, words, words in links, and whether it stands in an article, around one, under a name of an article, in a heading.

    Tags that don't match, unknown ones and unclosed ones are taken as browsers do, roughly; what is left open at the end is closed.
    Text outside of elements is a block, too. White space is one blank, also for br.
    """
    out: list[tuple[str, int, int, int, int, int, int]] = []
    open_: list[tuple[str, bool, bool, bool, bool]] = []
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        if words:
            article = around = by_name = named = heading = False
            for tag, is_article, is_around, is_by_name, is_named in open_:
                if is_article:  # a name around an article is that of a wrapper
                    article, by_name = True, False
                around, named, heading = around or is_around, named or is_named, heading or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
                by_name = by_name or (is_by_name and not (tag == "header" and article))
            out.append((" ".join(words), len(words), min(linked, len(words)), int(article), int(around or by_name), int(named), int(heading)))
        pieces.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            pieces.append(piece)
            if any(e[0] == "a" for e in open_):
                linked += len(piece.split())

    while True:
        found = _TAG.search(page, at)
        text(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        slash, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS or tag in HIDDEN:
            flush()
        if slash:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
                if tag not in BLOCKS and open_[i][0] in BLOCKS:
                    break
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in VOID:
            continue
        if tag in HIDDEN:
            if tag == "head":
                continue
            ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>" if tag in RAW else rf"<(/?){re.escape(tag)}\b[^>]*>", re.I)
            depth = 1
            while depth and (end := ends.search(page, at)):
                depth, at = depth + (1 if tag not in RAW and not end.group(1) and not end.group().endswith("/>") else -1), end.end()
            if depth:
                at = len(page)
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        closes, until = ENDS.get(tag, ({"p"}, {"table", "td", "th", "button", "article", "section", "div", "body"}) if tag in BLOCKS else (set(), set()))
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in closes:
                del open_[i:]
                break
            if open_[i][0] in until or not closes:
                break
        if tag == "a":
            open_ = [e for e in open_ if e[0] != "a"]
        open_.append((tag, *_marks(tag, attributes)))
    flush()
    return out


#: The labelled table: pages in which +n stands for a block of n words of main text and -n for one of n words around it.
SAMPLES = (
    "<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+60<p>+1<p>+2</p><p>+120</p></article><footer>-7</footer>",
    "<header><h1>-3</h1><p>-12</p></header><main><h2>+5</h2><p>+30</p><ul><li>+4</li><li>+9</li><li>+1</li></ul><p>+80 <a>+3</a></p><blockquote>+25</blockquote></main><aside><h3>-2</h3><p>-40</p></aside>",
    "<div id=menu><a>-1</a> <a>-1</a></div><div id=content><h1>+6</h1><p>+45</p><p>+3</p><p>+70</p></div><div id=sidebar><h3>-2</h3><p>-35</p><p>-20</p></div><div id=footer>-12</div>",
    "<div class=top-nav><p>-3</p></div><div class=post-body><p>+90</p><p>+2</p><h3>+4</h3><p>+33</p></div><div class=comments><h3>-2</h3><p>-50</p><p>-8</p><p>-25</p></div>",
    "<div class=cookie-notice><p>-22</p></div><article><header><h1>+7</h1><p>+4</p></header><p>+150</p><div class=newsletter><p>-15</p><form>-3</form></div><p>+50</p><footer>-6</footer><section class=comments><h2>-1</h2><article class=comment><p>-60</p></article></section></article>",
    "<table><tr><td><a>-1</a><td><a>-2</a><td><a>-1</a></table><p>+70</p><p>+40</p><p>+9</p><p>+66</p><p><a>-2</a> <a>-1</a> <a>-3</a></p><p>-4 <a>-2</a></p>",
    "<h1>+6</h1><p>+55</p><h2>+3</h2><p>+34</p><p>+12</p><p>+60</p>",
    "<div><a>-2</a></div><div><a>-1</a></div><div><a>-3</a></div><div><h1>+9</h1><p>+44</p><p>+100</p><p>+7</p><p>+52</p></div><div>-5</div><div><a>-2</a></div><div><a>-2</a></div>",
    "<body class=has-sidebar><div class=content-sidebar-wrap><article class=post><h1>+5</h1><p>+20</p><p>+11 <a>+2</a> +3</p><p>+1</p></article></div><div class=related-posts><p>-10</p><p><a>-8</a></p></div></body>",
    "<main><article><p>+15</p><ul><li><a>-3</a><li><a>-4</a><li><a>-2</a><li><a>-5</a></ul></article></main><div role=contentinfo>-9</div><div role=dialog><p>-30</p></div>",
    "<article><h1>+4</h1><p>+6</p></article>",
    "<article><p>+2</p></article><footer><p>-45</p></footer>",
    "<article><h2>+3</h2><p>+18 <a>+6</a></p><pre>+22</pre><table><tr><td>+1<td>+1<tr><td>+2<td>+1</table><p>+5</p><aside>-33</aside></article><nav><a>-1</a><a>-1</a></nav>",
    "<div class=story><p>+200</p><p>+14</p></div><p>-3</p><p><a>-4</a></p><p><a>-3</a></p>",
    "<article><h1>+3</h1><p>+6 <a>+9</a></p><p>+2</p><p><a>+11</a></p><p>+8 <a>+2</a> +1 <a>+4</a></p><h2>+2</h2><p><a>+5</a> +4</p><ul><li><a>+2</a> +3</li><li>+5 <a>+4</a></li></ul></article>",
    "<main><p>+4</p><p>+30 <a>+25</a></p><h3>+1</h3><p><a>+3</a> +2</p><p>+7</p></main><p><a>-2</a></p><p>-2</p>",
    "<article><p>+3</p><p><a>+1</a></p><p>+44</p><h2><a>+4</a></h2><p>+9</p><p>+1 <a>+1</a></p></article>",
    "<div><h1>+5</h1><p>+20 <a>+12</a></p><p>+40 <a>+5</a> +10</p><p>+6 <a>+3</a> +8</p><p>+33</p></div><div>-2 <a>-3</a></div><div><a>-1</a> -1 <a>-1</a></div>",
    "<p>-1</p><div><a>-1</a></div><div><a>-2</a></div><p>+25</p><p>+18 <a>+9</a></p><p>+41</p><ul><li><a>-3</a></li><li><a>-6</a></li><li><a>-2</a></li></ul>",
    "<article><h1>+2</h1><p>+50</p><ul><li><a>-2</a></li><li><a>-1</a></li><li><a>-1</a></li><li><a>-3</a></li></ul></article><article><p>+5</p><p>+1</p><p>+1</p></article>",
    "<article><p>+9</p><p>+20 <a>+20</a></p><p>+12</p></article>",
    "<nav><a>-2</a></nav><main><p>+3 <a>+5</a></p><p>+2</p></main>",
    "<article><p>+7 <a>+7</a></p><p>+1</p></article><article><p>+4 <a>+9</a></p><p>+60</p></article>",
    "<div class=alert>-14</div><div class=entry-content><p>+31</p><p>+28</p><div class=sharing><a>-1</a><a>-1</a></div></div><div class=sponsored>-60</div>",
)
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "around", "named", "heading")


def _described(found: Column) -> Column:
    """Blocks as structs of text and FEATURES; beyond the first and the last stand empty blocks."""

    def of(block: Column, name: str) -> tuple[Column, Column]:
        words = F.coalesce(block["words"], F.lit(0)).cast("double")
        return words.alias(f"words{name}"), F.coalesce(block["linked"] / F.greatest(block["words"], F.lit(1)), F.lit(0.0)).alias(f"density{name}")

    own = lambda b: [b[c].cast("double").alias(c) for c in ("article", "around", "named", "heading")]
    return F.transform(found, lambda b, i: F.struct(b["text"].alias("text"), *of(b, ""), *of(F.get(found, i - 1), "_before"), *of(F.get(found, i + 1), "_after"), *own(b)))


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """label and FEATURES of the blocks of SAMPLES."""
    filled = [re.sub(r"([+-])(\d+)", lambda m: m[1] + " ".join(["w"] * int(m[2])), page) for page in SAMPLES]
    found = spark.createDataFrame([(blocks(page),) for page in filled], f"blocks {BLOCK}")
    return found.select(F.explode(_described(F.col("blocks"))).alias("b")).select("b.*").withColumn("label", F.startswith("text", F.lit("+")).cast("double")).drop("text")


def fit(spark: SparkSession, depth: int = 10) -> str:
    """A decision tree over FEATURES for the labelled table, as Spark ML tells it."""
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled_blocks(spark))
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=13).fit(table.select("label", "features").coalesce(1)).toDebugString


def is_text(tree: str, block: Column) -> Column:
    """Whether a tree as fit() tells it takes a block for main text."""
    lines = iter(line.strip() for line in tree.splitlines()[1:] if line.strip())

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict:"):
            return F.lit(float(line.split()[1]) > 0.5)
        feature, bound = re.fullmatch(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
        below = node()
        next(lines)  # Else
        return F.when(block[FEATURES[int(feature)]] <= float(bound), below).otherwise(node())

    return node()


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the page's blocks, a row per row."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    kind = pa.list_(pa.struct([("text", pa.string()), *((n, pa.int32()) for n in ("words", "linked", "article", "around", "named", "heading"))]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "html"):
            found = [[dict(zip(names, b, strict=True)) for b in blocks(x.as_py())] for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, kind)], ["page_id", "url", "blocks"])

    return pages.mapInArrow(lambda b: freed(run(b)), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, blocks {BLOCK}")


def main_text(pages: DataFrame, tree: str | None = None, **columns: str) -> DataFrame:
    """page_id, url, text, n_chars of every page: its blocks of main text in order, joined by line feeds.

    A null page is an empty one; an empty page, or one without main text, has the empty text. Repeated rows stand for
    themselves, ids may be of any type or null, an empty table gives an empty one; other columns are left out.
    """
    found = page_blocks(pages, **columns).withColumn("described", _described(F.col("blocks")))
    tree = tree or fit(pages.sparkSession)
    texts = F.transform(F.filter("described", lambda b: is_text(tree, b)), lambda b: b["text"])
    out = found.select("page_id", "url", F.array_join(texts, "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
