"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page is parsed into a tree of its block elements, labelled by tag, class and
id (numbers in names as 0); runs of like siblings become one repeated node. Trees are merged into the host's wrapper by simple tree matching:
equal roots, and the order-keeping assignment of their children that matches most nodes. A wrapper node remembers on how
many pages it stood, on how many it had text of its own, and that text while it is the same everywhere (constant:
template) or the fact that it varies (a slot).

Extraction aligns a page with its host's wrapper. A block of text is content if it lies in the content region (below
article or main elements where the page itself has content in such, else anywhere), is not inside an element that is
navigation, header, footer, aside, form, advert, notice or comments by tag, role, class or id, and is no constant node.
Class and id count by the last word that says something (`site-header`, `ad-slot`; not `alert-study`) and not at all on
headings, paragraphs, article and main elements; in an article or main element ids and a class of its header do not
count either.
Nodes count as constant only outside article and main elements, and if the same text of theirs stands on every page of
at least `LEAST_PAGES` different pages. Pages differ if their text does, without that of elements left out, so that
copies of an article under other adverts, scripts or comments never turn it into template. Without article or main, copies that also
differ in unmarked text (a counter) cannot be told from pages of a template.

Texts of scripts, styles, templates, titles, textareas and iframes are no text of the page; what stands in other embedded
elements (svg, math, object, video, audio, canvas, noscript) is. A quote in a tag is a delimiter only after `=` and if
it is closed.

All pages take part. A wrapper keeps only the nodes that stand on all of its pages, as no other can be constant, so it is
no larger than the smallest page, whatever names the pages give their elements; nodes without a counterpart in it are
content. Each task merges its own pages by host, then the wrappers of a host are merged in two steps, the first salted,
so a host with a third of all pages is a few small trees per task. Wrappers without a constant node are left away, the
others join pages by host, where adaptive execution broadcasts them if they are small and splits large hosts if not.
NULL html gives an empty text, NULL
urls and such without `://` share one wrapper of the empty host; repeated rows each give their text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import store
from argweave.llm.urls import host_and_path

LEAST_PAGES, SALTS, DEEPEST = 8, 16, 150
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Elements of HTML by how they nest and break text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table select menu".split())
BESIDE = frozenset("nav header footer aside form menu dialog select button".split())
ROLES = frozenset("navigation banner contentinfo complementary form search menu menubar dialog alertdialog alert".split())
# Names of the kinds that are left out, and words that may follow one in a name without saying more.
_KIND = re.compile(
    r"ads?|advert\w*|sponsor(?:s|ed|ship)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|aside|footer|header|masthead|comments?|"
    r"respond|disqus|cookies?|consent|notices?|alerts?|pagination|pager|complementary|contentinfo", re.I)  # fmt: skip
_PLAIN = re.compile(r"\w*\d\w*|bar|box|wrap|wrapper|container|area|section|block|list|items?|inner|outer|left|right|top|bottom|main|slot|unit|links?", re.I)
_NOT = frozenset("no has with without hide show".split())
NAMELESS = frozenset("article main h1 h2 h3 h4 h5 h6 p".split())
VARIES = "*"


def _says_kind(name: str) -> bool:
    """True if a class or id names a kind that is left out: by its last word, as `site-header` or `ad-slot`, not `header-files`."""
    words = [w for w in re.split(r"[-_]+", name.split("--", 1)[0]) if w]
    while len(words) > 1 and _PLAIN.fullmatch(words[-1]) and not _KIND.fullmatch(words[-1]):
        words.pop()
    return bool(words) and _KIND.fullmatch(words[-1]) is not None and not _NOT.intersection(words[:-1])


#: What `_beside` has answered in this task. A plain dict travels by value, an object of lru_cache only by name.
_ANSWERS: dict[tuple, bool] = {}


def _beside(*names: str | bool) -> bool:
    """`_named_beside`, remembered: pages of a host repeat their elements."""
    found = _ANSWERS.get(names)
    if found is None:
        if len(_ANSWERS) >= 10_000:
            _ANSWERS.clear()
        found = _ANSWERS[names] = _named_beside(*names)
    return found


def _named_beside(tag: str, inside: bool, classes: str, id_: str, role: str) -> bool:
    """True for an element of a kind that is left out; `inside` is whether it stands in an article or main element."""
    if tag in BESIDE or not ROLES.isdisjoint(role.lower().split()):
        return True
    if tag in NAMELESS:
        return False
    names = classes.split() if inside else [*classes.split(), *id_.split()]
    return any(_says_kind(n) and not (inside and n.lower().endswith("header")) for n in names)


class Node:
    """An element of a page: its label, block children and own text blocks."""

    __slots__ = ("tag", "label", "parts", "beside", "inside", "plain")

    def __init__(self, tag: str, label: str, beside: bool, inside: bool = False):
        self.tag, self.label, self.parts, self.beside, self.inside, self.plain = tag, label, [], beside, inside, None


def parse(page: str) -> Node:
    """The tree of block elements; `parts` holds child nodes and strings of text between them, in page order.
    Below `DEEPEST` levels each text block is a leaf of the element at that level, so that trees can be walked."""
    root = Node("html", "html", False)
    stack, held, opened = [root], [], Counter()

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            top = stack[-1]
            if text and len(stack) <= DEEPEST:
                top.parts.append(text)
            elif text:
                leaf = Node(top.tag, top.label, top.beside, top.inside)
                leaf.parts.append(text)
                stack[DEEPEST - 1].parts.append(leaf)

    def close(to: int) -> None:
        flush()
        for node in stack[to:]:
            opened[node.tag] -= 1
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:1] != "<" or m[0] == "<":
                held.append(m[0])
            continue
        tag = tag.lower()
        if not m[4]:  # the page ends inside a tag
            break
        if m[1]:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag == "br":
                held.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID and tag != "hr":
            held.append(" " if tag == "br" else "")
            continue
        if tag not in BLOCKS or tag in ("html", "body"):
            continue
        names = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])[::-1]} if m[3] else {}  # the first of a name counts
        if tag in CLOSES_P and opened["p"]:
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "p"))
        if any(opened[x] for x in ALIKE.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in FENCES:
                    break
                if stack[k].tag in ALIKE[tag]:
                    close(k)
                    break
        flush()
        if tag == "hr":
            continue
        classes, id_ = names.get("class", ""), names.get("id", "")
        inside = stack[-1].inside or tag in ("article", "main")
        beside = stack[-1].beside or _beside(tag, inside, classes, id_, names.get("role", ""))
        node = Node(tag, _DIGITS.sub("0", f"{tag}.{classes}#{id_}") if classes or id_ else f"{tag}.#", beside, inside)
        if len(stack) < DEEPEST:
            stack[-1].parts.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return root


# A wrapper node is [label, text, pages, children]: text is "" (none) or (a digest, or VARIES if it is not always the same;
# on how many pages it is there).


def _plain(node: Node) -> list:
    """A page's whole tree as wrapper nodes, runs of like siblings merged into one. No text is constant in elements that are
    left out, or in article and main elements, but their nodes count where like siblings are told apart."""
    if node.plain is not None:
        return node.plain
    children: list[list] = []
    for part in node.parts:
        if isinstance(part, Node):
            child = _plain(part)
            if children and children[-1][0] == child[0]:
                children[-1] = merge(children[-1], child, same_page=True)
            else:
                children.append(child)
    text = "" if node.beside or node.inside else _own(node)
    node.plain = [node.label, [text, 1] if text else "", 1, children]
    return node.plain


def _own(node: Node) -> str:
    """The digest of an element's own text, empty without any."""
    text = "\n".join(p for p in node.parts if isinstance(p, str))
    return xxhash.xxh64_hexdigest(text) if text else ""


def match(a: list, b: list, memo: dict | None = None) -> int:
    """Simple tree matching: the most nodes of two trees that can be paired with order and ancestry kept."""
    if a[0] != b[0]:
        return 0
    if not a[3] or not b[3]:
        return 1
    memo = {} if memo is None else memo
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + _table(a[3], b[3], memo)[-1][-1]
    return memo[key]


def _table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        row = [0]
        for j, y in enumerate(ys):
            paired = best[-1][j] + match(x, y, memo) if x[0] == y[0] else 0
            row.append(max(best[-1][j + 1], row[j], paired))
        best.append(row)
    return best


def align(xs: list, ys: list, memo: dict | None = None) -> list[tuple[int | None, int | None]]:
    """Places of the children of two matched nodes, paired or alone, in an order that keeps both."""
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [(k, k) for k in range(len(xs))]
    both = {x[0] for x in xs} & {y[0] for y in ys}  # others pair with none
    us, vs = [k for k, x in enumerate(xs) if x[0] in both], [k for k, y in enumerate(ys) if y[0] in both]
    best = _table([xs[k] for k in us], [ys[k] for k in vs], {} if memo is None else memo)
    i, j, pairs = len(us), len(vs), [(len(xs), len(ys))]
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((us[i], vs[j]))
    out: list[tuple[int | None, int | None]] = []
    p = q = 0
    for i, j in reversed(pairs):
        out += [(k, None) for k in range(p, i)] + [(None, k) for k in range(q, j)] + [(i, j)]
        p, q = i + 1, j + 1
    return out[:-1]


def merge(a: list, b: list, same_page: bool = False, memo: dict | None = None) -> list:
    """The wrapper of both; roots have equal labels. Of different pages only paired nodes stay: what is not on every
    page is never constant, so a wrapper is no larger than its smallest page."""
    text = a[1] or b[1]
    if a[1] and b[1]:
        text = [VARIES if same_page or a[1][0] != b[1][0] else a[1][0], 1 if same_page else a[1][1] + b[1][1]]
    children, memo = [], {} if memo is None else memo
    for i, j in align(a[3], b[3], memo):
        if i is not None and j is not None:
            children.append(merge(a[3][i], b[3][j], same_page, memo))
        elif same_page:
            children.append(b[3][j] if i is None else a[3][i])
    return [a[0], text, a[2] if same_page else a[2] + b[2], children]


def _joined(a: dict, b: dict) -> dict:
    return {"tree": merge(a["tree"], b["tree"]), "seen": sorted({*a["seen"], *b["seen"]})[:LEAST_PAGES]}


def _page_wrapper(root: Node) -> dict:
    """The wrapper of a page; pages count as different by their text, without that of the kinds that are left out."""
    digest, rest = xxhash.xxh64(), [root]
    while rest:
        part = rest.pop()
        if isinstance(part, str):
            digest.update(f"{part}\n")
        elif not part.beside:
            rest.extend(reversed(part.parts))
    return {"tree": _plain(root), "seen": [digest.hexdigest()]}


def _constants(node: list, pages: int) -> bool:
    return bool(node[1]) and node[1][0] != VARIES and node[1][1] == pages or any(_constants(c, pages) for c in node[3])


def useful(wrapper: dict) -> bool:
    """False if no node can be constant: then texts are the same without the wrapper."""
    return len(wrapper["seen"]) >= LEAST_PAGES and _constants(wrapper["tree"], wrapper["tree"][2])


def extract(root: Node, wrapper: dict | None) -> list[str]:
    """The content blocks of a page, in page order."""
    tree = wrapper["tree"] if wrapper is not None and useful(wrapper) else None
    pages = tree[2] if tree is not None else 0
    out: list[tuple[bool, str]] = []

    def walk(node: Node, known: list | None) -> None:
        if node.beside:
            return
        constant = not node.inside and known is not None and known[1] != "" and known[1][1] == pages and known[1][0] == _own(node)
        kids = [p for p in node.parts if isinstance(p, Node)]
        slots: dict[int, list] = {}
        if known is not None and known[3] and kids and not node.inside:
            runs, of = _plain(node)[3], [0]
            for last, kid in zip(kids[:-1], kids[1:], strict=True):
                of.append(of[-1] + (last.label != kid.label))
            paired = {j: i for i, j in align(known[3], runs) if i is not None and j is not None}
            slots = {k: known[3][paired[r]] for k, r in enumerate(of) if r in paired}
        k = 0
        for part in node.parts:
            if isinstance(part, Node):
                walk(part, slots.get(k))
                k += 1
            elif not constant:
                out.append((node.inside, part))

    walk(root, tree)
    fenced = any(inside for inside, _ in out)
    return [part for inside, part in out if inside or not fenced]


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from pages (host, html), for the hosts with a constant node."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    new = _page_wrapper(parse(page))
                    found[host] = _joined(found[host], new) if host in found else new
            if len(found) > 5000:  # hosts in a task without bound: hand over what there is
                yield _rows(found)
                found = {}
        yield _rows(found)

    def together(batches: Iterator[pa.RecordBatch], final: bool = False) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                new = json.loads(text)
                if host == last:
                    held = _joined(held, new)
                    continue
                if held is not None and (useful(held) or not final):
                    yield _rows({last: held})
                last, held = host, new
        if held is not None and (useful(held) or not final):
            yield _rows({last: held})

    kinds = "host string, wrapper string"
    salted = pages.select("host", "html").mapInArrow(own, kinds).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    first = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(together, kinds)
    return first.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(lambda batches: together(batches, True), kinds)


def _rows(found: dict[str, dict]) -> pa.RecordBatch:
    texts = [json.dumps(w, separators=(",", ":")) for w in found.values()]
    return pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array(texts, pa.string())})


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    hosted = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    wrappers = store(induce(hosted), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if not page:
                    texts.append("")
                    continue
                if wrapper is not None and wrapper not in read:
                    if len(read) > 2000:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                texts.append("\n".join(extract(parse(page), None if wrapper is None else read[wrapper])))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    joined = hosted.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
