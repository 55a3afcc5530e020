"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html as html_codes
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: What they hold is not text to read.
OPAQUE = RAW | frozenset("noscript template svg math object canvas audio video select option datalist".split())
#: Not part of an article wherever they stand.
ASIDE = frozenset("nav footer aside button input dialog menu search".split())
#: Roles that say the same.
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar toolbar form".split())
#: They run on within a line; all other elements start and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph when they begin.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Begin tag, the open tags that it ends, and where the search for them stops.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
CONTAINER = frozenset(("article", "main"))
#: Parts of a text, not whole ones.
PARTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption figcaption".split())
#: Elements of HTML that end an open drawing or formula when they begin.
OUT_OF_DRAWING = ENDS_P | INLINE - frozenset(("a",)) | frozenset("body head li dd dt".split())
#: Words of a class or id that speak against a part of a page, if all words of the name are among these and the next.
HINTS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer menu nav navbar navigation newsletter notice notices notification pager pagination paywall popup modal promo promos promoted promotion recommendation recommendations recommended related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words that go with them and say nothing alone.
BESIDE = frozenset("area article articles bar block blocks bottom box buttons button center col column container content e email entry gdpr group header holder icon icons inner item items js left letter links link list main module new news number numbers outer page panel popular post posts right row section sign signup site slot stories story tabs text title top tracking unit up us wrap wrapper".split())
#: Readers' remarks, which may be longer than what they remark on, and words that go with them.
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
OF_REMARKS = frozenset("all body form fb facebook footer meta reader readers reply thread user users visitor".split())
#: They may also name a part of an article; they count where one at least of the parts below looks like a remark.
MAYBE_REMARKS = frozenset("discussion feedback forum guestbook opinions responses reviews thread".split())
#: What remarks have: a time, an answer to click, someone who says it.
WHEN = re.compile(r"\b(?:\d{1,2}:\d{2}|\d+ ?(?:s|sec|secs|m|min|mins|h|hr|hrs|hours?|d|days?|w|weeks?|months?|years?|minutes?|seconds?) ago|vor \d+ \w+|il y a \d+|hace \d+|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|yesterday|gestern|hier|ayer|just now)\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}\b|\d{1,2}\. \w{3,9} \d{4}", re.I)
SAYS = re.compile(r"\W*\w[\w .'-]{0,40}? (?:says|said|wrote|writes|commented|posted|schrieb|sagt|meint|a écrit|escribió)\b", re.I)
ANSWER = re.compile(r"\W*(?:reply|answer|report|like|upvote|quote|antworten|melden|répondre|signaler|responder|回复)\b", re.I)
WHO = frozenset("author avatar by byline commenter nick nickname user username vcard".split())
#: Elements that a remark may be.
REMARK = frozenset("article blockquote details div li section tr".split())
OPENS = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
#: One attribute as HTML reads it: quotes count after an equals sign only; or the end of the tag.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?)")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "kids", "drop", "hint", "names", "weak", "chars", "tags", "link_chars", "link_tags", "density", "total", "depth")

    def __init__(self, tag: str, up: Node | None, drop: bool, names: str = ""):
        self.tag, self.up, self.kids, self.drop, self.names, self.depth = tag, up, [], drop, names, up.depth + 1 if up else 0
        self.hint, self.weak = 0, False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: dict[str, str], contained: bool) -> bool:
    """By element, role, or because it is not shown. A page's header goes, that of an article or main element stays."""
    role = attributes.get("role", "").lower()
    if tag in OPAQUE or tag in ASIDE or role in ASIDE_ROLES and role != "banner":
        return True
    if tag == "header" or role == "banner":
        return not contained
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _named(node: Node) -> int:
    """3 for names of readers' remarks, 2 for names that may be, 1 for other names that speak against a part, 0 else."""
    if not node.names or node.tag in INLINE and node.tag != "span" or node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") or node.tag in CONTAINER:
        return 0
    best = 0
    for name in node.names.split():
        words = {w.lower() for w in SPLIT.split(name) if w}
        if words & REMARKS and words <= REMARKS | OF_REMARKS | BESIDE | MAYBE_REMARKS:
            return 3
        if words & MAYBE_REMARKS and words <= MAYBE_REMARKS | OF_REMARKS | BESIDE:
            best = 2
        elif words & HINTS and words <= HINTS | BESIDE:
            best = max(best, 1)
    return best


def _start(node: Node, most: int = 160) -> tuple[str, bool, bool, bool]:
    """(the first letters of a node, whether it has a time element, one that names who says it, one to answer); few nodes are looked at."""
    out, size, timed, who, answer, seen, todo = [], 0, False, False, False, 0, [node]
    while todo and seen < 60:
        n = todo.pop()
        seen += 1
        if isinstance(n, str):
            if size < most:
                out.append(n[:most])
                size += len(n)
            continue
        timed |= n.tag == "time"
        if n is not node and n.names and {w.lower() for w in SPLIT.split(n.names)} & WHO:
            who = True
        if n.tag in ("a", "button", "span") and len(n.kids) == 1 and isinstance(n.kids[0], str) and len(n.kids[0]) < 24 and ANSWER.match(n.kids[0]):
            answer = True
        if not n.drop or n.tag == "button":
            todo += reversed(n.kids)
    return SPACE.sub(" ", " ".join(out)).strip()[:most], timed, who, answer


def _looks_said(node: Node) -> tuple[int, bool]:
    """(how many of time, speaker and answer a part has, whether it has more than a speaker)."""
    start, timed, who, answer = _start(node)
    first = next((k for k in node.kids if not isinstance(k, str) or k.strip()), None)
    while isinstance(first, Node) and first.tag in ("div", "header", "p") and first.kids and not who:
        first = next((k for k in first.kids if not isinstance(k, str) or k.strip()), None)
    if isinstance(first, Node) and first.tag in ("b", "strong", "a", "cite", "span", "em", "h4", "h5", "h6") and len(first.kids) == 1 and isinstance(first.kids[0], str) and 0 < len(first.kids[0].strip()) <= 40:
        who = True
    who = who or bool(SAYS.match(start))
    timed = timed or bool(WHEN.search(start))
    return timed + who + answer, timed or answer


def mark(nodes: list[Node]) -> None:
    """Set what speaks against each node: ``hint`` 2 for forms and readers' remarks, 1 for other parts by their names, and for what is below.

    Remarks are found by their names, or by their shape: siblings of one element and class, most of which have two of a
    time, someone who says it and an answer to click, the time or the answer among them. Siblings of which most have a
    speaker only are ``weak``: that decides between parts, as a list in an article may look so. A form around most of the
    page's text is the page's, not a form in it.
    """
    root = nodes[0]
    for n in nodes:
        own, said = _named(n), 0
        groups: dict[tuple, list[Node]] = {}
        for k in n.kids:
            if isinstance(k, Node) and k.tag in REMARK and not k.drop and k.chars:
                groups.setdefault((k.tag, k.names.split(" ", 1)[0]), []).append(k)
        for like in groups.values():
            if len(like) > 1 or own == 2:
                looks = [_looks_said(k) for k in like[:40]]
                sure = sum(marks > 1 and more for marks, more in looks)
                said = max(said, sum(more for _, more in looks))
                if len(like) > 1 and 5 * sure >= 3 * len(looks):
                    for k in like:
                        k.hint = 2
                elif len(like) > 1 and 5 * sum(marks > 0 for marks, _ in looks) >= 4 * len(looks) and not any(x.tag in ("h1", "h2", "h3") for k in like for x in k.kids if isinstance(x, Node)):
                    n.weak = True
        if n.tag == "form" and 2 * n.chars < root.chars or own == 3 or own == 2 and said:
            n.hint = 2
        elif own == 1:
            n.hint = max(n.hint, 1)
    for n in nodes[1:]:
        n.hint = n.hint or n.up.hint
        n.weak = n.weak or n.up.weak


def _attributes(html: str, pos: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, where the tag ends, whether by a slash) from behind a tag's name; the first of equal names stands.

    A tag that does not end before the page does takes the rest with it.
    """
    out: dict[str, str] = {}
    end = len(html)
    while pos < end:
        m = ATTRIBUTE.match(html, pos)
        if m[1]:
            return out, m.end(), html[m.end() - 2] == "/" and m[0] != ">" and "/" in m[0]
        if m.end() == pos:
            break
        pos = m.end()
        if m[2]:
            value = m[3] or m[4] or m[5] or ""
            out.setdefault(m[2].lower(), html_codes.unescape(value) if "&" in value else value)
    return out, end, False


def parse(html: str) -> Node:
    """The tree of a page. Missing end tags are supplied, stray ones passed over; text stands as strings in kids.

    The tags of html, head and body make no nodes: the root stands for the body, whether or not they are written.
    """
    root = at = Node("body", None, False)
    drawings = 0  # open svg and math
    # open nodes by tag, from the outermost, and those that aren't within a line: no tag climbs over what is open
    opened: dict[str, list[Node]] = {}
    solid = [root]
    pos, end = 0, len(html)

    def leave(node: Node) -> None:
        """Close everything up to and with the node."""
        nonlocal at, drawings
        while True:
            opened[at.tag].pop()
            if at.tag not in INLINE:
                solid.pop()
            drawings -= at.tag in ("svg", "math")
            last, at = at, at.up
            if last is node:
                return

    def innermost(tags) -> Node | None:
        return max((opened[t][-1] for t in tags if opened.get(t)), key=lambda n: n.depth, default=None)

    while pos < end:
        m = OPENS.search(html, pos)
        text = html[pos : m.start() if m else end]
        if text:
            at.kids.append(html_codes.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            close = html.find("-->" if m[3] else ">", pos - 2 if m[3] else pos)
            pos = end if close < 0 else close + (3 if m[3] else 1)
            continue
        tag = m[2].lower()
        if html.startswith(">", pos):
            attributes, pos, closed = {}, pos + 1, False
        else:
            attributes, pos, closed = _attributes(html, pos)
        if tag in ("html", "head", "body"):
            continue
        if m[1]:
            if opened.get(tag):
                leave(opened[tag][-1])
            elif tag == "p":
                at.kids.append(Node("p", at, at.drop))
            continue
        if drawings and tag in OUT_OF_DRAWING:
            x = innermost(("svg", "math", "foreignobject", "desc", "annotation-xml"))
            if x.tag in ("svg", "math"):
                leave(x)
        if tag in ENDS_P and opened.get("p"):
            if solid[-1].tag == "p":
                leave(solid[-1])
        elif tag in ENDS:
            ended, stop = ENDS[tag]
            least = x.depth if (x := innermost(stop)) is not None else -1
            found = (opened[t][k] for t in ended if opened.get(t) and (k := bisect_right(opened[t], least, key=lambda n: n.depth)) < len(opened[t]))
            last = min(found, key=lambda n: n.depth, default=None)
            if last is not None:
                leave(last)
        node = Node(tag, at, at.drop or _unwanted(tag, attributes, bool(opened.get("article") or opened.get("main"))), f"{attributes.get('class', '')} {attributes.get('id', '')}".strip() if attributes else "")
        at.kids.append(node)
        if tag in VOID or closed and (drawings or tag in ("svg", "math")):
            continue
        if tag in RAW and not drawings:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            pos = _attributes(html, found.end())[1] if found else end
            continue
        opened.setdefault(tag, []).append(node)
        if tag not in INLINE:
            solid.append(node)
        drawings += tag in ("svg", "math")
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """Kept nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    return out


def measure(root: Node) -> list[Node]:
    """Composite density of each kept node, and the sum of its children's.

    With C characters and T tags below a node, LC and LT of them in links, and LCb and Cb those of the page:
    density = C/T * log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e), which is kept at e or more.
    """
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars += sum(len(SPACE.sub("", k)) for k in n.kids if isinstance(k, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.up is not None:
            n.up.chars += n.chars
            n.up.tags += n.tags + 1
            n.up.link_chars += n.link_chars
            n.up.link_tags += n.link_tags
    share = root.link_chars / max(1, root.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, max(1, n.link_tags)
        if c:
            base = max(math.e, math.log(c / max(1, c - lc) * lc + share * c + math.e))
            n.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt), base))
    for n in nodes:
        if n.up is not None:
            n.up.total += n.density
    return nodes


def _within(node: Node, outer: Node) -> bool:
    while node is not None and node is not outer:
        node = node.up
    return node is outer


def main_nodes(root: Node) -> list[Node]:
    """The content, in page order.

    The subtree with the largest density sum is the first choice, or the body if most of the text stands in it
    without a container of its own. A paragraph or a run within a line is no choice. The least density on its path to the body is the
    threshold: below each node that reaches it, the subtree with the largest sum is taken too. A top heading beside
    the first choice is its title.

    What ``mark`` says decides where densities leave it open: readers' remarks and forms are chosen only if there is nothing else,
    another part that its names speak against only if no other has a tenth of its sum, and neither is taken besides
    another. A list that may be remarks gives way to an article or main element. Within what is chosen remarks and forms are left
    out, and other parts that all words of a name speak against if they have less than a third of the characters. If the
    first choice holds most of an article or main element, that is taken whole, and nothing outside of it.
    """
    nodes = measure(root)
    mark(nodes)
    rank = lambda x: (x.total, x.density, -x.depth)
    loose = sum(len(SPACE.sub("", k)) if isinstance(k, str) else k.chars for k in root.kids if isinstance(k, str) or k.tag in PARTS and not k.drop)
    inner = [n for n in nodes if n is not root and n.chars and n.tag not in PARTS]
    best = max(inner, key=rank) if inner and 2 * loose <= root.chars else root
    plain = max((n for n in inner if not n.hint), key=rank, default=best)
    held = max((n for n in inner if n.tag in CONTAINER and not n.hint and not n.weak), key=rank, default=None)
    if best.hint == 2 and (plain.chars >= 40 or held is not None) or best.hint and 10 * plain.total >= best.total and 10 * plain.chars >= best.chars:
        best = plain
    if best.weak and held is not None and not _within(best, held):
        best = held
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    whole = next((n for n in path if n.tag in CONTAINER and 2 * best.chars >= n.chars), None)
    while whole is not None and (around := next((n for n in path[path.index(whole) + 1 :] if n.tag == whole.tag), None)) is not None:
        whole = around  # an article within an article is part of it
    if whole is not None:
        chosen = [whole]
    else:
        least = min(x.density for x in path if x is not root or x is best)
        peak: dict[Node, Node | None] = {}
        for n in reversed(nodes):
            below = [peak[k] for k in n.kids if peak.get(k)]
            peak[n] = max(below + [n] * (n.tag not in PARTS), key=rank, default=None)
        marked = {best, *(k for k in (best.up.kids if best.up else ()) if isinstance(k, Node) and k.tag == "h1" and not k.drop)}
        marked |= {peak[n] or n for n in nodes if n.density >= least and n is not root and not n.hint and not (n.weak and not best.weak)}
        chosen, todo = [], [root]
        while todo:
            n = todo.pop()
            if n in marked and (n.density >= least or n is best or n.tag == "h1") and (n is best or not n.hint):
                chosen.append(n)
            else:
                todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    if not best.hint:
        for top in chosen:
            for n in _order(top):
                if n.hint and n is not top and (n.hint == 2 or 3 * n.chars < top.chars):
                    n.drop = True
    return chosen


def _blocks(node: Node) -> list[str]:
    out, line, todo = [], [], [(node, False)]

    def close() -> None:
        if text := SPACE.sub(" ", "".join(line)).strip():
            out.append(text)
        line.clear()

    while todo:
        n, done = todo.pop()
        if isinstance(n, str):
            line.append(n)
        elif done:
            close()
        elif n.tag == "br":
            line.append(" ")
        elif not n.drop:
            if n.tag not in INLINE:
                close()
                todo.append((n, True))
            todo += [(k, False) for k in reversed(n.kids)]
    close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if there is none."""
    root = parse(html or "")
    return "\n".join(b for n in main_nodes(root) for b in _blocks(n))


def extract(html: Column) -> Column:
    """The main text of each page of a column of HTML.

    Scripts, menus and the like are left out by element and role; the subtree with the largest density sum, and its
    peers above the threshold, are kept (see ``main_nodes``). Null, empty and text-free pages give an empty text; text
    without any tag is one block. Each row stands alone, so repeated rows give equal texts; other columns are not
    read. A tag that never ends takes the rest of the page with it, as in a browser.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return run(html)
