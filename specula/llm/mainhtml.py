"""The main text of web pages by scoring the element tree.

The page becomes a tree, with the end tags that HTML lets authors omit. Parts that are never article text (scripts,
forms, navigation, ...) or that say in a whole token of class, id or role that they are none (menus, adverts, comments, ...)
are cut, unless they hold most of the paragraph text. Names that are part of a token, or general words, lower an element's points and
cut it only if most of its text lies in links. Each paragraph then passes points for its length and commas to its parent, half of them to
the next element, a third further on; every element's points are discounted by the share of its text that lies in links.
The best container is kept, with the siblings that score well enough or read like paragraphs. An
``article`` or ``main`` element around the best container takes its place.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import slices
from specula.llm.bpe import _q

# Element names of the HTML standard, and names that authors give to parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html caption legend summary tbody td tfoot th thead tr dd dt li".split())
NEVER = set("script style noscript template head title iframe object embed applet svg math canvas audio video nav footer aside button select textarea "
            "input label option menu dialog map".split())
NAMES = set("ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
            "sidebar aside rail header masthead topbar footer colophon bottom cookie cookies consent gdpr notice notices notification alert warning disclaimer popup modal overlay "
            "comment comments commentlist respond reply replies disqus discussion share sharing social follow related recommended recommendations more newsletter subscribe subscription "
            "signup login search searchform form widget widgets toolbar pagination pager paging tags tagcloud copyright legal skip hidden complementary contentinfo".split())
#: general words, which do not tell by themselves; parts that can be longer than the article; words for what a page has or lacks around its text
GENERAL = set("more bottom header rail follow related legal".split())
LONG = set("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr popup modal overlay".split())
#: words beside such a name that only say what kind of box it is
BOXES = set("area block box container holder inner item items list outer panel section slot unit user users wrap wrapper".split())
#: names of what holds an article and its own header
POSTS = set("article entry hentry post story".split())
ABOUT_PAGE = set("no not non has have with without".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: what a start tag ends, up to the container in the second set
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}


class Element:
    __slots__ = ("tag", "about", "up", "inside", "points", "worth")

    def __init__(self, tag: str, about: str, up):
        self.tag, self.about, self.up, self.inside, self.points, self.worth = tag, about, up, [], 0.0, 1.0


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", "", None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self.at = self.at.up
        about = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            about += " hidden"
        made = Element(tag, about, self.at)
        self.at.inside.append(made)
        if tag not in VOID:
            self.at = made

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _end(self, tags, within) -> None:
        here = self.at
        while here.up is not None and here.tag not in within:
            if here.tag in tags:
                self.at = here.up
                return
            here = here.up

    def handle_endtag(self, tag):
        here = self.at
        while here.up is not None:
            if here.tag == tag:
                self.at = here.up
                return
            if here.tag in ("table", "article", "body") and tag not in BLOCK:
                return
            here = here.up

    def handle_data(self, data):
        self.at.inside.append(data)


def _cut(e: Element) -> bool:
    """Is this element no article text, by its tag?"""
    if e.tag in NEVER:
        return True
    if e.tag == "header":  # of the page; within an article it holds the article's title
        if any(not isinstance(x, str) and x.tag == "p" for x in e.up.inside) or not POSTS.isdisjoint(re.findall("[a-z]+", e.up.about.lower())):
            return False
        up = e.up
        while up is not None and up.tag not in ("article", "main"):
            up = up.up
        return up is None
    return False


def _named(e: Element) -> tuple[bool, bool, bool]:
    """(whole, part, long): do its names say that it is none in a whole token, in a part of one, and that it may be longer than the article?"""
    whole = part = long = False
    if e.tag == "form":  # some sites have the whole page in one
        whole = True
    if e.about and (e.tag not in ("html", "body", "article", "main") or re.search(r"comment|reply", e.about, re.I)):
        for token in e.about.split():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if words and ABOUT_PAGE.isdisjoint(words):
                telling = [w in NAMES and w not in GENERAL for w in words]
                if any(telling) and all(t or w in BOXES for t, w in zip(telling, words)):
                    whole = True
                    long |= not LONG.isdisjoint(words)
                elif not NAMES.isdisjoint(words):
                    part = True
    return whole, part, long


def _walk(root: Element) -> list[Element]:
    """All elements before what they contain, without the cut ones."""
    out, todo, named = [], [root], {}
    while todo:
        e = todo.pop()
        out.append(e)
        e.inside = [x for x in e.inside if isinstance(x, str) or not _cut(x)]
        todo += [x for x in reversed(e.inside) if not isinstance(x, str)]
        if any(found := _named(e)):
            named[id(e)] = found
    if not named:
        return out
    text, linked, paragraph, title, article = {}, {}, {}, {}, {}
    for e in reversed(out):
        k, within = id(e), [id(x) for x in e.inside if not isinstance(x, str)]
        text[k] = sum(len(x.strip()) for x in e.inside if isinstance(x, str)) + sum(text[x] for x in within)
        linked[k] = text[k] if e.tag == "a" else sum(linked[x] for x in within)
        paragraph[k] = text[k] if e.tag == "p" else sum(paragraph[x] for x in within)
        title[k] = e.tag in ("h1", "main") or any(title[x] for x in within)
        article[k] = e.tag in ("article", "main") and text[k] > 0 or any(article[x] for x in within)
    share = paragraph if paragraph[id(root)] else text

    def stays(e: Element) -> bool:
        k = id(e)
        whole, part, long = named.get(k, (False, False, False))
        most = 2 * share[k] > share[id(root)] and (title[k] or not long) and (article[k] or not article[id(root)])
        if most or not (whole or part):
            return True
        if not whole and (2 * linked[k] < text[k] or not text[k]):
            e.worth = 0.75
            return True
        return False
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        e.inside = [x for x in e.inside if isinstance(x, str) or stays(x)]
        todo += [x for x in reversed(e.inside) if not isinstance(x, str)]
    return out


def blocks(kept: list) -> list[str]:
    """The texts between borders of blocks, in page order, with white space as one space."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()
    todo = list(reversed(kept))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.inside)
        else:
            todo += reversed(x.inside)
    flush()
    return out


def extract(html: str | None) -> str:
    """The main text: blocks joined by an empty line. Empty without any text."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    every = _walk(tree.root)
    size, linked, plain, commas, title = {}, {}, {}, {}, {}
    for e in reversed(every):  # contained elements come first
        n = marks = 0
        inner = near = near_marks = links = 0
        titled = e.tag == "h1"
        for x in e.inside:
            if isinstance(x, str):
                n += len(x.strip())
                marks += x.count(",") + x.count("、")
            else:
                k = id(x)
                inner += size[k]
                links += linked[k]
                titled |= title[k]
                if x.tag not in BLOCK:
                    near += plain[k]
                    near_marks += commas[k]
        k = id(e)
        plain[k], commas[k], size[k] = n + near, marks + near_marks, n + inner
        linked[k] = size[k] if e.tag == "a" else links
        title[k] = titled
    best = None
    for e in every:
        k = id(e)
        if e.tag in BLOCK and e.tag not in HEADINGS and plain[k] > 0 and e.tag not in ("html", "body"):
            points = (1 + commas[k] + min(plain[k] / 100, 3)) * (1 - linked[k] / max(size[k], 1))
            up, far = (e.up, 1) if e.tag != "div" else (e, 1)
            while up is not None and up.tag:
                up.points += points / far
                up, far = up.up, far + 1
    for e in every:
        e.points *= e.worth * (1 - linked[id(e)] / max(size[id(e)], 1))
        if e.points > 0 and (best is None or e.points > best.points):
            best = e
    if best is None:
        # no paragraph at all: whatever text is left
        return "\n\n".join(blocks([tree.root]))
    up, around = best, None
    while up is not None:
        if up.tag in ("article", "main") and around is None or up.tag == "article":
            around = up
        up = up.up
    if around is not None and around.points > 0:
        # articles beside it count if they are no teasers: as long as a quarter of it at least, with few links
        beside = around.up.inside if around.tag == "article" else [around]
        return "\n\n".join(blocks([x for x in beside if x is around or not isinstance(x, str) and x.tag == "article" and 4 * size[id(x)] >= size[id(around)] and 10 * linked[id(x)] < 3 * size[id(x)]]))
    if best.up is None or best.tag in ("html", "body"):
        return "\n\n".join(blocks([best]))
    kept, between = [], []
    for x in best.up.inside:
        before = len(kept)
        if x is best:
            kept.append(x)
        elif not isinstance(x, str):
            dense = linked[id(x)] / max(size[id(x)], 1)
            long = size[id(x)] > 80 and dense < 0.25 or size[id(x)] and dense == 0 and x.tag == "p"
            if x.points >= 0.2 * best.points or long and x.tag in BLOCK or (x.tag in HEADINGS or title[id(x)] and dense < 0.5) and size[id(x)]:
                kept.append(x)
            elif kept and x.tag in ("ul", "ol", "dl", "blockquote", "table", "pre", "figure") and 2 * linked[id(x)] < size[id(x)]:
                between.append(x)  # stays if more of the text follows
        if len(kept) > before:
            kept[before:before] = between
            between = []
    return "\n\n".join(blocks(kept))


def main_text(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with text, the main text of column ``html``, and n_chars, its number of code points.

    Null and empty pages and pages without text give an empty text. Whole pages are read, broken and truncated ones too. No row moves;
    repeated rows give repeated results, an empty table an empty one. Kept columns named like the added ones give way.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.select(*[_q(c) for c in keep]).schema]

    def run(batches):
        import pyarrow as pa
        for batch in slices(batches, 64):
            found = [extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*keep, "text", "n_chars"])
    return pages.select(*[_q(c) for c in keep], F.coalesce(_q(html), F.lit("")).alias("__html")).mapInArrow(run, ", ".join([*fields, "text string", "n_chars bigint"]))
