"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block elements into flat blocks. Each has its word count and link density, those of its neighbours, and
what it stands in (article, navigation, form, comment and so on, told by elements and by names in class, id and role). A
decision tree, trained by Spark on the small labelled table below, says which blocks are main text; the tree is then walked
over whole columns of block features. What a block stands in does not decide alone: lists of links inside an article are no
text, and on pages without an article paragraphs are told by length, density and neighbours.

A block also knows whether the page has an article and how long its longest block is, so that short notices that are a
whole page stay, and lines beside an article that no name tells from text go. Names are words of a class, id or role. Those of ``html``, ``body``, ``main`` and ``article`` are not read (they describe the
page), nor are those that say what a page has or lacks (has-sidebar); ``main`` forgets what it stands in, and ``article``
forgets outer names except those of comments.

Defined cases: null and empty pages give an empty text; unclosed elements end where their parent does, and ``li``, ``p``
and table cells where the next begins; a head ends at its end tag, at ``body``, or at the first element or word that may not
stand in it; an unclosed comment, script or style runs to the end; text without any element is
one block; null ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STR, quoted, schema, spread

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "object", "iframe", "head", "title", "canvas", "audio", "video", "map", "select", "textarea"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr"}
#: What may stand in a head; any other element ends it.
HEADING = re.compile("h[1-6]")
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: What ends an open element of the same or a listed kind without an end tag.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
WHITE_RUN = re.compile(r"\s+")
END_OF_RAW = {name: re.compile(f"</{name}", re.I) for name in RAW}

#: Kinds of surroundings, each a bit of a block's features: by element, and by words in class, id or role.
ARTICLE, NAV, CHROME, ASIDE, NOTICE, ADVERT, FORM, COMMENT = (1 << i for i in range(8))
BY_ELEMENT = {"article": ARTICLE, "main": ARTICLE, "nav": NAV, "menu": NAV, "footer": CHROME, "header": CHROME, "aside": ASIDE, "form": FORM, "button": FORM, "fieldset": FORM, "dialog": NOTICE}
BY_NAME = {
    ARTICLE: "story entrycontent postbody postcontent maincontent maintext articlebody articlecontent",
    NAV: "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc tabs",
    CHROME: "footer header masthead siteinfo sitetitle copyright contentinfo skip topbar",
    ASIDE: "sidebar aside widget widgets related recommended recommendations share sharing social tags complementary byline promoted teaser teasers",
    NOTICE: "cookie cookies consent notice alert gdpr banner popup modal overlay newsletter subscribe paywall",
    ADVERT: "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp",
    FORM: "form search login signup searchbox",
    COMMENT: "comment comments reply replies disqus discussion respond",
}
NAME_BITS = {word: bit for bit, words in BY_NAME.items() for word in words.split()}
#: What may stand behind a name in a compound one: words for a container or its place (sidebar-left, comment-list).
HOLDERS = frozenset(
    "area bar block body bottom box button buttons center col column container content group header heading holder icons inner item items left link links list main meta outer panel "
    "position post posts primary right row secondary section slot strip title top unit widget widgets wrap wrapper".split()
)
SAYS_OF_PAGE = {"has", "with", "without", "no", "not", "is", "js"}
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "article", "nav", "chrome", "aside", "notice", "advert", "form", "comment", "page_article", "page_longest")


def attributes_of(written: str) -> dict[str, str]:
    """A tag's attributes; the first of one name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(written):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def hidden(attributes: dict[str, str]) -> bool:
    """Whether a tag's attributes keep its element from being shown."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or NO_DISPLAY.search(attributes.get("style", "")) is not None


def named(attributes: dict[str, str]) -> int:
    """What the words of class, id and role tell: single ones, and neighbours joined (entry-content). In a compound name the
    last word tells, and one with nothing but words for a container or numbers behind it (reply-text says nothing)."""
    bits = 0
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").lower().split():
            words = [w for w in re.split(r"[_-]+", token) if w]
            if words and words[0] not in SAYS_OF_PAGE:
                for k in range(len(words) - 1, -1, -1):
                    bits |= NAME_BITS.get(words[k], 0)
                    if k + 1 < len(words):
                        bits |= NAME_BITS.get(words[k] + words[k + 1], 0)
                    if words[k] not in HOLDERS and words[k] not in NAME_BITS and not words[k].isdigit():
                        break
    return bits


def closes_itself(written: str) -> bool:
    """Whether a slash before the end of a tag is more than the last character of an unquoted value."""
    return written.endswith("/") and written[-2:-1] in ("", " ", "\t", "\n", "\r", "\f", "'", '"')


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, heading, surroundings) of each block with text, in page order. Time is in proportion to
    the page: open elements are counted by name, and those that are no inline elements are kept by place."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, int, bool]] = []  # element; surroundings by element and by name, with its parents'; silent
    parts: list[tuple[str, bool]] = []
    open_: Counter[str] = Counter()
    solid: list[int] = []  # places in the stack of all but inline elements
    heading, at, ended = 0, 0, len(page)

    def flush() -> None:
        nonlocal heading
        if parts:
            text = WHITE_RUN.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = sum(len(p.split()) for p, in_link in parts if in_link)
                out.append((text, text.count(" ") + 1, linked, heading, stack[-1][1] | stack[-1][2] if stack else 0))
            parts.clear()

    def close(to: int) -> None:
        while len(stack) > to:
            open_[stack.pop()[0]] -= 1
        while solid and solid[-1] >= to:
            solid.pop()

    def opened(name: str) -> int | None:
        """The place that an end tag closes. Inline ones reach no further than the element around them."""
        if open_[name]:
            for k in range(len(stack) - 1, solid[-1] if name in INLINE and solid else -1, -1):
                if stack[k][0] == name:
                    return k
        return None

    while at < ended:
        m = TAG.search(page, at)
        raw = page[at : m.start() if m else ended]
        if stack and stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if raw and not (stack and stack[-1][3]):
            parts.append((html.unescape(raw) if "&" in raw else raw, open_["a"] > 0))
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            k = opened(name)
            if k is not None:
                close(k)
            heading = 0 if HEADING.fullmatch(name) else heading
            continue
        if name not in IN_HEAD and solid and stack[solid[-1]][0] == "head":  # an open head ends here, but not inside a template, say
            close(solid[-1])
        if name == "br":
            parts.append((" ", open_["a"] > 0))
            continue
        if name not in INLINE:
            flush()
            heading = int(bool(HEADING.fullmatch(name)))
            ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            while solid and stack[solid[-1]][0] in ends:
                close(solid[-1])
        attributes = attributes_of(m[3]) if m[3] else {}
        if name in VOID or closes_itself(m[3]):
            continue
        by_element, by_name, silent = stack[-1][1:] if stack else (0, 0, False)
        if name == "main":
            by_element = by_name = 0
        elif name == "article":
            by_name &= COMMENT
        elif name not in ("html", "body"):
            by_name |= named(attributes) if attributes else 0
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, by_element | BY_ELEMENT.get(name, 0), by_name, silent or name in SILENT or hidden(attributes)))
        open_[name] += 1
        if name in RAW:  # no markup inside
            end = END_OF_RAW[name].search(page, at)
            at = end.start() if end else ended
    flush()
    return out


def features(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words, linked = np.array([b[1] for b in found], float), np.array([b[2] for b in found], float)
        density, around = np.minimum(linked / words, 1), np.array([b[4] for b in found])
        out[:, 0], out[:, 1] = words, density
        out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
        out[:, 6] = [b[3] for b in found]
        for i in range(8):
            out[:, 7 + i] = (around >> i) & 1
        out[:, 15], out[:, 16] = (around & ARTICLE).any(), (words - linked).max()
    return out


#: The labelled table: small pages whose blocks were judged by hand. In them [[...]] marks main text.
LABELLED = (
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav><article><h1>[[A title]]</h1><p>[[First words of the text that go on for a good while and hold no link at all, as prose does.]]</p><p>[[Short.]]</p><p>[[More prose with <a href=x>one link</a> in it, which is usual and changes nothing.]]</p></article><footer>&copy; a site. All rights reserved by the owners of the site.</footer>",
    "<header><p>The daily paper</p></header><main><h2>[[News]]</h2><p>[[One.]]</p><p>[[Two words.]]</p><ul><li>[[A point of a list]]</li><li>[[Another point that is longer than the first]]</li></ul></main><aside><p>Read next: something else that many people have read and liked over the week.</p></aside>",
    "<div class=ad>Buy the very best kettles at the very best prices, today only, in all our shops.</div><article><p>[[Text.]]</p><div class=advert>Buy now</div><p>[[Text again, rather longer, so that it takes a line or even two on a narrow page.]]</p></article><div class=cookie-notice>We use cookies to make this site better. By reading on you agree to our use of them.</div>",
    "<article><h1>[[On tea]]</h1><p>[[Tea is made with water.]]</p><form><label>Your mail</label><p>Get the letter every week in your box, free of charge and without any obligation.</p></form><section class=comments><h3>Comments</h3><p>I disagree with all of it, and I have made tea for forty years in three different towns.</p><p>Me too.</p></section></article>",
    "<p><a href=1>One</a> <a href=2>Two</a></p><p>[[A page without an article has its text in plain paragraphs, and long ones without links are the text of it, as everybody can see at once.]]</p><p>[[The next paragraph follows a long one and is long as well, so it is part of the same text and belongs to it.]]</p><p><a href=3>Next page</a></p>",
    "<div id=sidebar><p>About the writer: lives by the sea with two cats and writes about tea and about towns.</p><ul><li><a href=4>Old posts</a></li></ul></div><div class=post-content><p>[[A post.]]</p><p>[[It has a second paragraph with more words than the first one has.]]</p><blockquote>[[And a quotation.]]</blockquote></div><div class=footer><p>Imprint</p></div>",
    "<div class=menu><a href=5>Start</a> <a href=6>Shop</a> <a href=7>Contact</a></div><article><header><h1>Site of the week and of the year</h1></header><p>[[Here the text starts.]]</p><pre>[[x = 1]]</pre><table><tr><td>[[Cell]]</td><td>[[Other cell]]</td></tr></table><nav><a href=8>Earlier</a> <a href=9>Later</a></nav><aside>Related: the other site of the other week, which was good too.</aside></article>",
    "<article><p>[[The whole page is this.]]</p></article>",
    "<article><div class=related>You may also like a text on coffee.</div><p>[[A text with an aside.]]</p><aside>By the way.</aside><div class=newsletter>Subscribe to us.</div><p>[[The last words]]</p></article>",
    "<main><p>[[It begins]]</p><div class=social>Share this</div><p>[[and it ends with no footer behind it, after some more words]]</p></main>",
    "<p>Log in</p><p>Share</p><p>Menu</p><article><p>[[ok]]</p><p>[[<a href=10>A paragraph that is one link</a>]]</p></article><p>Top</p><p>Terms</p>",
)


WORDS = "the of and to in a is that for it as was with be by on not but at are this have from or had an they which one you were all there would their we him been has when who will more no if out so said what up its about into than them can only other".split()


def said(n: int, start: int = 0) -> str:
    """n words."""
    return " ".join(WORDS[(start + 7 * k) % len(WORDS)] for k in range(n))


def link(n: int, start: int = 0) -> str:
    return f"<a href=/x>{said(n, start)}</a>"


def layouts(seed: int = 1, rounds: int = 24) -> list[str]:
    """Labelled pages of six kinds, with lengths drawn anew in every round: a page in plain paragraphs with menus and a last
    line around it; an article with lists of links in it; an article of short blocks; teasers that lead elsewhere; lines that
    belong to no text; blocks of all lengths that are told by what they stand in, beside text."""
    out, draw = [], random.Random(seed)
    n = draw.randint
    row = lambda: "<p>" + " ".join(link(n(1, 3), n(0, 50)) for _ in range(n(2, 7))) + "</p>"
    links = lambda: "<ul>" + "".join(f"<li>{link(n(1, 6), i)}</li>" for i in range(n(2, 8))) + "</ul>"
    menu = lambda: draw.choice((row, links))()
    plain = lambda a, b: f"<p>{said(n(a, b), n(0, 50))}</p>"
    text = lambda a, b: f"<p>[[{said(n(a, b), n(0, 50))}]]</p>"
    long, any_ = lambda: text(28, 150), lambda: text(1, 150)
    mixed = lambda: f"<p>[[{said(n(20, 90))} {link(n(1, 8))} {said(n(5, 30))}]]</p>"
    for k in range(rounds):
        for _ in range(8):  # a short paragraph stands between long ones
            body = "".join(draw.choice((long, long, mixed))() + draw.choice((text(1, 24), text(1, 8), "")) for _ in range(n(2, 6)))
            out.append(f"{menu()}{body}{long()}{menu()}{plain(10, 25)}{menu()}")
        out.append(f"{links()}{plain(1, 20)}{links()}{long()}{long()}{mixed()}{menu()}{plain(1, 20)}")
        out.append(f"{menu()}<article><h1>[[{said(n(1, 30))}]]</h1>{any_()}{mixed()}{links()}{any_()}<p>[[{said(n(2, 6))} {link(n(1, 4))} {said(n(3, 9))}]]</p>{any_()}</article>{menu()}")
        out.append(f"<article>{any_()}<p>[[{link(n(1, 12))}]]</p>{any_()}{any_()}<p>[[{link(n(1, 12))}]]</p>{mixed()}</article>")
        out += [f"<article>{text(1, 40)}</article>", f"<article>{any_()}{text(1, 20)}</article>", f"<article>{any_()}<aside>{plain(1, 20)}</aside></article>"]
        out.append(f"<article>{any_()}<ul><li>[[{said(n(1, 30))}]]</li><li>[[{said(n(1, 30))}]]</li></ul>{any_()}{row()}{links()}{row()}</article>")
        out.append(f"{links()}<article><h1>[[{said(n(1, 12))}]]</h1>" + "".join(text(1, 12) for _ in range(n(2, 9))) + f"</article><footer>{plain(1, 30)}</footer>")
        out.append("".join(f"<h3>{link(n(2, 9))}</h3>{plain(8, 24)}" for _ in range(n(2, 5))) + menu())
        out.append(f"{plain(1, 12)}{plain(1, 8)}<article>{any_()}</article>{plain(1, 8)}{plain(1, 12)}")
        for kind in ("div class=ad", "aside", "footer", "header", "div class=cookie-notice", "div class=comments", "form"):
            extra = lambda kind=kind: f"<{kind}>{plain(1, 90)}</{kind.split()[0]}>"
            out.append(f"{links()}{extra()}<article><h1>[[{said(n(1, 30))}]]</h1>{any_()}{extra()}{any_()}{any_()}</article>{extra()}")
            if k % 3 == 0:
                out.append(f"{menu()}{extra()}{long()}{extra()}{long()}{text(1, 24)}{long()}{extra()}{menu()}")
    return out


def headed(seed: int = 2, rounds: int = 200) -> list[str]:
    """Labelled pages of three more kinds: text under headings without an article, short notices that are a whole page, and
    lines around an article that no name tells apart from text."""
    out, draw = [], random.Random(seed)
    n = draw.randint
    text = lambda a, b: f"<p>[[{said(n(a, b), n(0, 50))}]]</p>"
    plain = lambda a, b: f"<p>{said(n(a, b), n(0, 50))}</p>"
    title = lambda level, b: f"<h{level}>[[{said(n(1, b), n(0, 50))}]]</h{level}>"
    menu = lambda: "<ul>" + "".join(f"<li>{link(n(1, 4), n(0, 50))}</li>" for _ in range(n(2, 7))) + "</ul>"
    for _ in range(rounds):
        part = lambda: title(2, 9) + text(28, 120) + draw.choice(("", text(1, 1), text(1, 20))) + text(28, 120)
        out.append(f"{draw.choice(('', menu()))}{title(1, 14)}{draw.choice(('', text(1, 3)))}{text(28, 120)}{text(1, 2)}{part()}{draw.choice(('', part()))}{menu()}")
        out.append(f"{draw.choice(('', menu()))}{title(1, 9)}{text(2, 24)}{draw.choice(('', text(2, 24), text(2, 24) + text(2, 24)))}{draw.choice(('', menu()))}")
        out.append(f"{draw.choice(('', menu()))}{plain(1, 45)}<article>{title(1, 14)}{text(1, 120)}{text(1, 120)}{text(1, 60)}</article>{plain(1, 45)}{menu()}")
    return out


def labelled_rows(pages: Iterable[str]) -> list[tuple[float, ...]]:
    """(label, features...) of every block of labelled pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(float("[[" in b[0]), *map(float, f)) for b, f in zip(found, features([(b[0].strip("[]"), *b[1:]) for b in found]))]
    return rows


class Tree:
    """A trained tree as arrays, walked over many blocks at once."""

    def __init__(self, feature: list[int], limit: list[float], left: list[int], right: list[int], label: list[float]):
        self.feature, self.limit, self.left, self.right, self.label = (np.array(x) for x in (feature, limit, left, right, label))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.left[at] >= 0).any():
            low = x[np.arange(len(x)), self.feature[at]] <= self.limit[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.label[at] > 0.5


#: Trees of this process by depth: the labelled table is fixed, so one fit serves all calls.
TRAINED: dict[int, Tree] = {}


def train(spark: SparkSession, max_depth: int = 14) -> Tree:
    """The tree of the labelled table, pages judged by hand eightfold; fitted once, to some thousands of rows."""
    if max_depth not in TRAINED:
        TRAINED[max_depth] = fitted(spark, max_depth)
    return TRAINED[max_depth]


def fitted(spark: SparkSession, max_depth: int) -> Tree:
    data = spark.createDataFrame(labelled_rows([*LABELLED * 8, *layouts(), *headed()]), ["label", *FEATURES])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("label", "features").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=max_depth, maxBins=128, minInstancesPerNode=1, seed=1).fit(data)
    nodes: tuple[list, ...] = ([], [], [], [], [])

    def add(node) -> int:
        k = len(nodes[0])
        for to, x in zip(nodes, (0, 0.0, -1, -1, node.prediction())):
            to.append(x)
        if node.numDescendants():
            nodes[0][k], nodes[1][k] = node.split().featureIndex(), node.split().threshold()
            nodes[2][k] = add(node.leftChild())
            nodes[3][k] = add(node.rightChild())
        return k

    add(model._call_java("rootNode"))
    return Tree(*nodes)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text): blocks of main text in page order, joined by an empty line."""
    tree = train(pages.sparkSession)
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column(2):
                found = blocks(page.as_py())
                keep = tree.predict(features(found)) if found else ()
                texts.append("\n\n".join(b[0] for b, k in zip(found, keep) if k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return spread(rows).mapInArrow(extract, schema(id=rows.schema["id"].dataType, url=rows.schema["url"].dataType, text=STR))
