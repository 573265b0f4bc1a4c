"""Main text of web pages by wrappers inferred per host: union-free regular expressions over token streams.

Every page becomes a tree of structural tokens (element name with its class, id and role) and text tokens. Equal
neighbours fold into repeated groups. The pages of a host are aligned one after the other with what was learnt so far:
tokens found on one side only become optional, runs of the same token become repeated groups, and texts that differ
become slots, so the result is a union-free expression ``(a, b?, (c)+, slot)`` that matches every page of the host.

Pages of equal structure are folded before any alignment, so a host costs one row per distinct structure and task;
wrappers of one host are then merged in a tree of bounded fan-in. Alignment of texts keeps a value or gives it up, and
its counts are sums, so a host of any size has a wrapper the size of its template.

The wrapper says what belongs to the article: elements that name themselves as navigation, notices, forms, adverts or
comments are dropped; the region is the article or main element, or else the container that holds most of the text that
is no link; lists whose items are links alone, and fixed texts repeated on every page, are template and go.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, one_by_one, stage
from quarry.llm.urls import host

#: Wrappers of a host merged at once, and pages on which a text must be the same to count as template.
FAN_IN = 128
FIXED_PAGES = 5
#: Nesting beyond which elements add no level, and children beyond which equal labels fold into one repeated choice.
DEEP, LONG = 150, 24
#: Pages parsed before their rows leave the task.
ROWS = 64

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names by role, and words by which elements name themselves.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe svg math title select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote body details dialog div dl fieldset figcaption figure footer form h1 h2 "
             "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "body", "html", "article", "main", "section", "div"}
DROP_TAGS = set("nav footer aside form menu dialog button select option textarea head script style noscript template "
                "iframe svg math fieldset title".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                 "toolbar".split())
DROP_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies "
                 "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing "
                 "social comment comments commentlist reply replies respond discussion disqus related recommended "
                 "recommendations breadcrumb breadcrumbs pagination pager sidebar sidebars menu nav navbar navigation "
                 "topbar toolbar masthead footer widget widgets search login copyright disclaimer tracking skip "
                 "paywall".split())
#: Words that add only layout to a name such as related-posts-box. Inside an article a name of other words, such as
#: search-algorithms, is its subject's, and headings are never dropped by name.
LAYOUT_WORDS = set("area bar block body box bottom btn button buttons col column container content count desktop fixed form "
                   "global group head header icon icons inner inline item items left link links list main mobile module "
                   "outer panel post posts primary right row secondary section side site slot small sticky text thread "
                   "title top unit wrap wrapper".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLES = set("ad ads advert advertisement comment comments promo related recommended reply replies sponsored "
                   "teaser widget".split())
MAIN_WORDS = {"content", "article", "post", "entry", "story", "main", "articlebody", "maincontent", "text", "body"}
LEAF = "#text"


class Node:
    """``label`` element, repeated or optional, with children; a leaf has a text (``None``: slot) and counts."""

    __slots__ = ("label", "many", "optional", "kids", "text", "pages", "chars", "linked", "moved")

    def __init__(self, label, kids=None):
        self.label, self.many, self.optional, self.kids = label, False, False, kids
        self.text, self.pages, self.chars, self.linked, self.moved = None, 1, 0, 0, None

    def final(self):
        n = self
        while n.moved is not None:
            n = n.moved
        return n


def _attributes(raw: str) -> dict:
    return {m[1].lower(): htmllib.unescape(m[2].strip("\"'")) if m[2] else "" for m in ATTRIBUTE.finditer(raw)}


def _label(tag: str, attrs: dict) -> str:
    """Name, class, id and role; digits in these, which number pages, become #."""
    if not attrs:
        return tag
    out = ""
    for key in ("class", "id", "role"):
        if value := attrs.get(key, "").strip():
            out += f"|{key}={' '.join(sorted(set(value.split())))}"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        out += "|hidden"
    return tag + re.sub(r"\d+", "#", out)


def parse(html: str):
    """``(root, blocks)``: the page's tree before folding, and its text blocks ``(text, leaf)`` in page order.

    Unclosed and misnested tags are repaired as browsers do in the common cases; whatever is open at the end is closed.
    """
    root = Node("html", [])
    stack: list[tuple[str, Node]] = [("html", root)]
    blocks: list[tuple[str, Node]] = []
    open_ = Counter()  # how many elements of a name are open
    buffer: list[str] = []
    link = [0, 0]  # depth of open links, characters inside them

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            leaf = Node(LEAF)
            leaf.text, leaf.chars, leaf.linked = text, len(text), min(link[1], len(text))
            stack[-1][1].kids.append(leaf)
            blocks.append((text, leaf))
        link[1] = 0

    def text(raw):
        if raw:
            raw = htmllib.unescape(raw)
            buffer.append(raw)
            if link[0]:
                link[1] += len(raw.strip())

    def close(names, scopes):
        if not any(open_[x] for x in names):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                open_.subtract(name for name, _ in stack[i:])
                del stack[i:]
                return True
            if stack[i][0] in scopes:
                return False
        return False

    at = 0
    while m := TOKEN.search(html, at):
        text(html[at:m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None or tag == "html":
            continue
        if m[1]:
            if tag == "a":
                link[0] = max(0, link[0] - 1)
            if tag in ("br", "p") and not (tag == "p" and open_["p"]):
                flush()
            elif tag not in VOID:
                close({tag}, {"article", "main", "body"} - {tag} if tag in INLINE else {"body"} - {tag})
                if tag not in INLINE:
                    link[0] = 0
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
                if end:  # nothing inside counts as markup, an opened comment neither
                    at = html.find(">", end.end() - 1) + 1 or len(html)
                elif tag in ("script", "style"):
                    at = len(html)  # never closed: nothing after it is text
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        if tag == "a":
            link[0] = 1
        attrs = _attributes(m[3]) if m[3].strip() else {}
        if tag in INLINE and not (attrs and _names(_label(tag, attrs)) & DROP_WORDS or "hidden" in attrs):
            continue
        if tag in VOID:
            continue
        flush()
        if tag == "body" and open_["body"]:
            continue
        if tag not in INLINE:
            if tag != "head":
                close({"head"}, set())
            if tag in ENDS_P:
                close({"p"}, SCOPES | {"li", "td", "th", "dd"})
            if tag in SIBLINGS:
                while close(SIBLINGS[tag], SCOPES if tag != "tr" else {"table", "body"}):
                    pass
            if tag in ("article", "main"):
                close({"nav", "header"}, {"article", "main", "body"})
        if len(stack) > DEEP:  # no level of its own, but its end tag closes it and nothing else
            node = stack[-1][1]
        else:
            node = Node(_label(tag, attrs), [])
            stack[-1][1].kids.append(node)
        if not m[0].endswith("/>") or tag in ENDS_P:
            stack.append((tag, node))
            open_[tag] += 1
    text(html[at:])
    flush()
    return root, blocks


def join_into(a: Node, b: Node) -> Node:
    """Aligns ``b`` with ``a`` (same label) and returns ``a``, now matching both."""
    a.many |= b.many
    a.optional |= b.optional
    b.moved = a
    if a.kids is None:
        if a.text != b.text:
            a.text = None
        a.chars += b.chars
        a.linked += b.linked
    else:
        a.kids = fold(align(a.kids, b.kids))
    return a


def align(x: list[Node], y: list[Node]) -> list[Node]:
    """Longest common subsequence of labels; what is on one side only becomes optional."""
    if [n.label for n in x] == [n.label for n in y]:
        return [join_into(a, b) for a, b in zip(x, y, strict=True)]
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i].label == y[j].label:
            out.append(join_into(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            x[i].optional = True
            out.append(x[i])
            i += 1
        else:
            y[j].optional = True
            out.append(y[j])
            j += 1
    return out


def fold(kids: list[Node]) -> list[Node]:
    """Folds runs that repeat one to three labels, such as ``p p p`` or ``dt dd dt dd``, into repeated nodes.

    A list that stays long becomes ``(a? b? c?)+``: one repeated, optional node per label, in order of appearance.
    """
    out: list[Node] = []
    for node in kids:
        out.append(node)
        changed = True
        while changed:
            changed = False
            for period in (1, 2, 3):
                if len(out) < 2 * period:
                    break
                left, right = out[-2 * period:-period], out[-period:]
                if [n.label for n in left] == [n.label for n in right]:
                    for a, b in zip(left, right, strict=True):
                        join_into(a, b)
                        a.many = True
                    del out[-period:]
                    changed = True
                    break
    if len(out) > LONG:
        first: dict[str, Node] = {}
        for node in out:
            a = first.setdefault(node.label, node)
            a.many = a.optional = True
            if a is not node:
                join_into(a, node)
        out = list(first.values())
    return out


def fold_all(node: Node) -> Node:
    """Folds a parsed tree from the bottom up."""
    if node.kids is not None:
        node.kids = fold([fold_all(k) for k in node.kids])
    return node


def shape(node: Node):
    """The structure alone, as nested lists."""
    flags = node.many + 2 * node.optional
    return [node.label, flags] if node.kids is None else [node.label, flags, [shape(k) for k in node.kids]]


def leaves_of(node: Node) -> list[Node]:
    if node.kids is None:
        return [node]
    return [x for k in node.kids for x in leaves_of(k)]


def build(spec, leaf) -> Node:
    """A tree from :func:`shape` and an iterator of leaf values ``[text hash, pages, chars, linked]``."""
    node = Node(spec[0], None if len(spec) == 2 else [build(k, leaf) for k in spec[2]])
    node.many, node.optional = bool(spec[1] & 1), bool(spec[1] & 2)
    if node.kids is None:
        node.text, node.pages, node.chars, node.linked = next(leaf)
    return node


def dump(node: Node) -> str:
    return json.dumps([shape(node), [[x.text, x.pages, x.chars, x.linked] for x in leaves_of(node)]],
                      separators=(",", ":"))


def load(text: str) -> Node:
    spec, values = json.loads(text)
    return build(spec, iter(values))


def merge(wrappers: list[str]) -> str:
    """One wrapper that matches whatever the given ones match; the most common structure comes first."""
    def weight(w):
        return -max((v[1] for v in json.loads(w)[1]), default=0), w

    def count(a: Node, b: Node):
        if a.kids is None:
            a.pages += b.pages

    first, *rest = sorted(set(wrappers), key=weight)
    root = load(first)
    for w in rest:
        other = load(w)
        before = {id(x): x.pages for x in leaves_of(root)}
        mine = leaves_of(other)
        join_into(root, other)
        for x in mine:  # a leaf that was aligned adds its pages to the leaf it became
            y = x.final()
            if y is not x:
                y.pages = before.get(id(y), y.pages) + x.pages
                before[id(y)] = y.pages
    return dump(root)


def _names(label: str) -> set[str]:
    """Words in the class and id of a label."""
    return {w.lower() for part in label.split("|")[1:] if not part.startswith("role=") for w in
            WORDS.findall(part.partition("=")[2])}


def _names_apart(label: str) -> list[set[str]]:
    """The words of each class and id of a label by itself."""
    return [{w.lower() for w in WORDS.findall(name)} for part in label.split("|")[1:] if not part.startswith("role=")
            for name in part.partition("=")[2].split()]


def _boilerplate(node: Node, inside: bool, total: int) -> bool:
    tag, *rest = node.label.split("|")
    if tag in ("html", "body", "main") or any(r == "role=main" for r in rest):
        return False
    if tag in DROP_TAGS or tag == "header" and not inside or "hidden" in rest:
        return not _holds(node, {"article", "main"}) or tag in ("head", "aside", "footer")
    if any(r.startswith("role=") and set(r[5:].split()) & DROP_ROLES for r in rest):
        return True
    own = _names(node.label)
    if tag == "article":
        return bool(own & NOT_ARTICLES)
    if inside:
        return tag not in HEADINGS and any(
            words & DROP_WORDS and words <= DROP_WORDS | LAYOUT_WORDS for words in _names_apart(node.label)) and \
            not _holds(node, {"article", "main"}) and 5 * _mass(node) < 4 * total
    # a container of nearly the whole page is named after its layout, such as has-sidebar
    return bool(own & DROP_WORDS) and not _holds(node, {"article", "main"}) and 5 * _mass(node) < 4 * total


def _holds(node: Node, tags: set[str]) -> bool:
    return any(k.label.split("|")[0] in tags and not _names(k.label) & DROP_WORDS or _holds(k, tags)
               for k in node.kids or ())


def _mass(node: Node) -> int:
    if node.kids is None:
        return max(0, node.chars - node.linked)
    return sum(map(_mass, node.kids))


def _links_only(node: Node) -> bool:
    """Whether a list holds links alone on every one of several pages; on few pages it may be the article's own."""
    items = [x for x in leaves_of(node)]
    return bool(items) and all(x.linked >= x.chars and x.pages >= FIXED_PAGES for x in items)


def classify(root: Node) -> set[int]:
    """The nodes of a wrapper, by identity, whose text is the article's."""
    live: list[Node] = []
    total = _mass(root)

    def prune(node, inside):
        if _boilerplate(node, inside, total):
            return None
        tag = node.label.split("|")[0]
        copy = Node(node.label, None if node.kids is None else [])
        copy.moved = node
        copy.text, copy.pages, copy.chars, copy.linked = node.text, node.pages, node.chars, node.linked
        for k in node.kids or ():
            if (kept := prune(k, inside or tag in ("article", "main"))) is not None:
                copy.kids.append(kept)
        return copy

    def find(node, test):
        if node.kids is None:
            return []
        if test(node) and _mass(node):
            return [node]
        return [x for k in node.kids for x in find(k, test)]

    page = prune(root, False)
    if page is None:
        return set()
    regions = (find(page, lambda n: n.label.split("|")[0] == "article" or "articlebody" in n.label.lower())
               or find(page, lambda n: n.label.split("|")[0] == "main" or "role=main" in n.label))
    if not regions:
        total = _mass(page)
        named = [n for n in find(page, lambda n: _names(n.label) & MAIN_WORDS and 2 * _mass(n) >= total)
                 if n.label.split("|")[0] not in ("html", "body")]
        regions = named[:1] or [page]
        while not named:  # the container that holds nearly all of the text
            down = [k for k in regions[0].kids if k.kids and 10 * _mass(k) >= 9 * total]
            if not down:
                break
            regions = down
    for region in regions:
        slots = any(x.text is None for x in leaves_of(region))

        def take(node, plain, slots=slots):
            tag, *marks = node.label.split("|")
            if node.kids is None:
                if plain or node.text is None or node.pages < FIXED_PAGES or not slots:
                    live.append(node.moved)
                return
            if tag in ("ul", "ol", "div") and len(leaves_of(node)) and _links_only(node):
                return
            for k in node.kids:
                take(k, not marks and tag in PLAIN)

        take(region, False)
    return {id(x) for x in live}


PLAIN = set("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption article main section body".split())


def turns(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
    """Matches the children ``x`` of a page with ``y`` of a wrapper as a regular expression: a repeated child may be
    followed by any repeated child again. As many of ``x`` as possible are matched, in as few turns as a scan finds."""
    n, m = len(x), len(y)
    first = next((j for j in range(m) if y[j].many), m)
    back = [first if w.many else j + 1 for j, w in enumerate(y)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i][j + 1], best[i + 1][j],
                             best[i + 1][back[j]] + 1 if x[i].label == y[j].label else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i].label == y[j].label and best[i][j] == best[i + 1][back[j]] + 1:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1 if best[i + 1][j + 1] == best[i + 1][back[j]] else back[j]
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return out


def matched(page: Node, wrapper: Node, chosen: set[int]) -> list[int] | None:
    """Numbers of the page's leaves whose place in the wrapper was chosen, by aligning the page with it.

    None if a part of the page has no place in the wrapper beside chosen ones.
    """
    place: set[int] = set()
    whole = True

    def match(node, w):
        nonlocal whole
        if node.kids is None:
            if id(w) in chosen:
                place.add(id(node))
            return
        x, y = node.kids, w.kids
        n, m = len(x), len(y)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = (best[i + 1][j + 1] + 1 if x[i].label == y[j].label
                              else max(best[i + 1][j], best[i][j + 1]))
        if best[0][0] < n:
            found = turns(x, y)
            if len(found) < n and any(id(leaf) in chosen for leaf in leaves_of(w)):
                whole = False
            for a, b in found:
                match(a, b)
            return
        i = j = 0
        while i < n and j < m:
            if x[i].label == y[j].label:
                match(x[i], y[j])
                i, j = i + 1, j + 1
            else:
                j += 1

    match(page, wrapper)
    if not whole:
        return None
    return [i for i, leaf in enumerate(leaves_of(page)) if id(leaf) in place]


def read_page(html: str):
    """``(structure, block texts, leaf number of each block, leaf values)`` of one page."""
    root, blocks = parse(html)
    fold_all(root)
    leaves = leaves_of(root)
    number = {id(x): i for i, x in enumerate(leaves)}
    return (json.dumps(shape(root), separators=(",", ":")), [t for t, _ in blocks],
            [number[id(x.final())] for _, x in blocks], leaves)


def own_choice(spec: str, chars, linked) -> list[int]:
    """Leaf numbers of the article of a page that speaks for itself."""
    root = build(json.loads(spec), iter([["", 1, c, x] for c, x in zip(chars, linked, strict=True)]))
    chosen = classify(root)
    return [i for i, leaf in enumerate(leaves_of(root)) if id(leaf) in chosen]


def scanned(pages: DataFrame) -> DataFrame:
    """Each page parsed once: structure, blocks with their leaves, and per leaf its text's hash and sizes."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part, rows = b.slice(at, ROWS), []
                for text in one_by_one(part.column("html")):
                    spec, texts, leaf, leaves = read_page(text)
                    rows.append((spec, texts, leaf,
                                 [None if x.text is None else xxhash.xxh64_intdigest(x.text) >> 1 for x in leaves],
                                 [x.chars for x in leaves], [x.linked for x in leaves]))
                ints = pa.list_(pa.int32())
                kinds = (pa.string(), pa.list_(pa.string()), ints, pa.list_(pa.int64()), ints, ints)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in own), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds,
                                                                                    strict=True))],
                    [*own, "spec", "blocks", "leaf", "fixed", "chars", "linked"])

    own = ["page_id", "url", "host"]
    return pages.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*own).schema)
                            + ", spec string, blocks array<string>, leaf array<int>, fixed array<long>, "
                              "chars array<int>, linked array<int>")


def wrappers(parsed: DataFrame) -> DataFrame:
    """``host, wrapper`` from the output of :func:`scanned`: one union-free expression per host, as JSON."""
    def fold_pages(batches):
        seen: dict[tuple, list] = {}

        def out():
            rows = [(h, f"[{s},{json.dumps(v, separators=(',', ':'))}]") for (h, s), v in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["host", "wrapper"])

        for b in batches:
            for h, spec, *own in zip(b["host"], b["spec"], b["fixed"], b["chars"], b["linked"], strict=True):
                fixed, chars, linked = ([None if pd.isna(x) else int(x) for x in y] for y in own)
                old = seen.get((h, spec))
                if old is None:
                    seen[h, spec] = [[f, 1, c, x] for f, c, x in zip(fixed, chars, linked, strict=True)]
                    continue
                for a, f, c, x in zip(old, fixed, chars, linked, strict=True):
                    if a[0] != f:
                        a[0] = None
                    a[1], a[2], a[3] = a[1] + 1, a[2] + c, a[3] + x
            if len(seen) > 20_000:
                yield out()
        if seen:
            yield out()

    def merged(key, group):
        return pd.DataFrame({"host": [key[0]], "wrapper": [merge(group["wrapper"].tolist())]})

    kind = "host string, wrapper string"
    found = stage(parsed.select("host", "spec", "fixed", "chars", "linked").mapInPandas(fold_pages, kind), "shapes")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // FAN_IN)
        by = F.pmod(F.xxhash64("wrapper"), F.lit(max(1, groups)))
        found = stage(found.groupBy("host", by).applyInPandas(merged, kind), "wrappers")
        if groups <= 1:
            return found


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``; others are not read).

    Null or empty html gives an empty text. Pages without a host share one wrapper. Repeated rows and null ids are
    extracted like any row. An empty table gives an empty result. Texts are never shortened. Fixed texts count as
    template only on ``FIXED_PAGES`` pages or more, and never in plain paragraphs or headings of the article, so hosts
    with few pages, or with copies of one page, lose nothing by it. A page for which its host's wrapper chooses nothing,
    or which has parts that the wrapper does not match beside chosen ones, is judged by its own structure.
    """
    parsed = stage(scanned(pages.select("page_id", "url", host(F.col("url")).alias("host"),
                                        F.coalesce("html", F.lit("")).alias("html"))), "parsed")
    learnt = wrappers(parsed)

    def choose(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for spec, w in zip(b["spec"], b["wrapper"], strict=True):
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                    tree = load(w)
                    known[w] = tree, classify(tree)
                spec = json.loads(spec)
                page = build(spec, iter(lambda: ["", 1, 0, 0], None))
                out.append(matched(page, *known[w]))
            yield pd.DataFrame({"h": b["host"], "s": b["spec"], "chosen": out})

    shapes = parsed.select("host", "spec").distinct()
    chosen = stage(shapes.join(learnt, "host").mapInPandas(choose, "h string, s string, chosen array<int>"), "chosen")
    size = chosen.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s") + 4 * F.greatest(F.size("chosen"), F.lit(0))).alias("w")).first()
    j = parsed.join(broadcast_if_small(chosen, 64 + (size["w"] or 0), size["n"]),
                    (F.col("host") == F.col("h")) & (F.col("spec") == F.col("s")), "left")

    def article(picked):
        kept = F.filter("blocks", lambda _, i: F.array_contains(picked, F.get("leaf", i)))
        return F.array_join(kept, "\n")

    text = article(F.coalesce("chosen", F.array().cast("array<int>")))
    some = j.withColumn("text", text)

    @F.pandas_udf("array<int>")
    def alone(spec: pd.Series, chars: pd.Series, linked: pd.Series) -> pd.Series:
        return pd.Series([own_choice(*x) for x in zip(spec, chars, linked, strict=True)])

    left = (some.filter("text = ''").withColumn("own", alone("spec", "chars", "linked"))
            .withColumn("text", article(F.col("own"))))
    return (some.filter("text <> ''").select("page_id", "url", "text")
            .unionByName(left.select("page_id", "url", "text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def extract(html: str | None) -> str:
    """The article's text of a single page, by its own structure."""
    spec, texts, leaf, leaves = read_page(html or "")
    own = set(own_choice(spec, [x.chars for x in leaves], [x.linked for x in leaves]))
    return "\n".join(t for t, i in zip(texts, leaf, strict=True) if i in own)
