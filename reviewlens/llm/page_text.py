"""Main text of web pages by wrappers inferred per host (union-free regular expressions).

1. A page becomes a tree of element tokens and text blocks; omitted end tags are
   implied, broken and cut-off markup closes where its parent closes.
   Formatting tags are part of the text.
2. Repeats are found inside every level: the same run of tokens twice or more
   in a row becomes one repeated group.
3. Wrappers of a host are aligned two at a time: tokens on one side only become
   optional, text that differs becomes a slot, equal tokens are aligned further
   down.  A wrapper is a tree of tokens with the marks ``?`` and ``+``, without
   unions.  A level of more than ``LEVEL`` tokens becomes a repeated group of
   optional ones, and unknown tags share one token, so a wrapper's size depends
   on the vocabulary of tags and not on the number of pages.  Wrappers are
   merged inside a slice of pages first, then by host in rounds of ``FAN``.
4. A page's text is weighed by its host's wrapper: text that the wrapper fixes
   (the same on ``TEMPLATE`` different pages or more) is template, slots are
   content.  The main region is the ``article`` or ``main`` element with most
   content, else the deepest element that holds most of it.  The region's
   blocks are the text, without menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and comments (by tag, or by the words of
   class, id and role), and without fixed text outside headings and paragraphs.

Defined results: a null or empty html, or a page without content, gives an
empty text; a null url belongs to the host ''; rows that repeat a ``page_id``
are treated each, pages that repeat in full count once for a wrapper; a host of
few pages has no template text; character references are decoded as HTML5 does;
white space (also no-break spaces) inside a block becomes one space; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, ship, small, text_slices, written

#: different pages on which a text must be the same to count as template
TEMPLATE = 5
#: tokens of one level of a wrapper, wrappers merged by one task and host
LEVEL, FAN = 64, 64
#: levels of elements; deeper text belongs to the last of them
DEPTH = 60
#: bytes of all wrappers that are broadcast; beyond, they are joined by host
BROADCAST_BYTES = 32 << 20

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav noscript ol optgroup option p pre search section select summary table tbody td template
    tfoot th thead title tr ul""".split())
FORMATTING = frozenset("""abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt
    ruby s samp small span strike strong sub sup time tt u var wbr""".split())
KNOWN = BLOCK | FORMATTING | VOID | frozenset("""a audio button canvas iframe label map math meter object
    output picture progress script style svg textarea video""".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: an opened tag ends these, up to the nearest one of the second list
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"),
    "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: never main text, whatever their class says
LEFT_OUT = frozenset("""aside button canvas dialog footer form head iframe menu nav noembed noframes noscript
    object script search select style svg template textarea title audio video""".split())
#: words of class, id and role that name what is not main text
ROLES = frozenset("""ad ads advert adverts advertisement advertising adsense advertorial banner breadcrumb
    breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright
    disqus feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter
    notice notices notification overlay pager pagination popup promo promoted promotion related replies
    reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser teasers
    toolbar widget widgets""".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|(?P<cut>\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                   re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HEADING = re.compile(r"h[1-6]$")


# --- pages ----------------------------------------------------------------------

class Node:
    """An element of a page; ``texts`` are its own text blocks among its children."""

    __slots__ = ("tag", "kids", "skip", "parent", "depth", "link")

    def __init__(self, tag, skip, parent):
        self.tag, self.skip, self.parent, self.kids = tag, skip, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)


def _named(tag, attrs):
    """What the class, id and role of a tag say: 'out', 'main' or ''."""
    out = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "out"
        if name in ("class", "id", "role"):
            if name == "role" and value.lower() == "main":
                out = "main"
            elif tag not in ("html", "body", "article", "main") and any(
                    w.lower() in ROLES for w in _SPLIT.split(value)):
                return "out"
        if name == "itemprop" and value.lower() == "articlebody":
            out = "main"
    return out


def parse(page: str) -> Node:
    """The tree of a page: nodes, and blocks as [text, chars, skipped, linked] lists."""
    root = Node("", False, None)
    # (tag, node, pushed): formatting and too deep tags share their parent's node
    stack = [("", root)]
    block: list | None = None
    at, size = 0, len(page)

    def close(n):
        nonlocal block
        if any(t in BLOCK or node.tag == "a" for t, node in stack[n:]):
            block = None
        del stack[n:]

    def say(text):
        nonlocal block
        if not text:
            return
        node = stack[-1][1]
        if block is None or block[1] is not node:
            beside = node.kids and (isinstance(node.kids[-1], list) or node.kids[-1].tag not in BLOCK)
            if not beside and not text.strip():
                return
            block = [[], node]
            node.kids.append(block)
        block[0].append(text)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or m["cut"] is not None:     # comments, declarations, a tag cut off at the end
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):        # a paragraph ends where a block starts
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            if tag in IMPLIED:
                ends, until = IMPLIED[tag]
                last = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] in ends:
                        last = i
                if last:
                    close(last)
            block = None
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        attrs = m["attrs"] or ""
        node = stack[-1][1]
        named = _named(tag, attrs) if attrs.strip(" /") else ""
        skip = tag in LEFT_OUT or named == "out" or (
            tag == "header" and not any(t in ("article", "main") for t, _ in stack))
        if (tag not in FORMATTING or skip or named) and node.depth < DEPTH:
            key = tag if tag in KNOWN else "other"
            node = Node("main" if named == "main" and key not in ("article", "main") else key,
                        skip or node.skip, node)
            node.parent.kids.append(node)
        elif skip and not node.skip:
            node = Node("other", True, node)
            node.parent.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else size
        stack.append((tag, node))
    return root


def blocks_of(root: Node):
    """(path, text, node) of the page's text blocks in order, white space made single.

    Inline elements (links, labels) join the block around them.
    """
    out: list = []

    def flush(parts):
        # one block per run of inline text; its path is that of the enclosing block element
        if parts:
            text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(t) for t, n in parts if n.link)
                out.append((parts[0][1], text, linked / max(1, sum(len(t) for t, _ in parts))))

    # depth is bounded by DEPTH, so recursion is too
    def visit(node, parts):
        for kid in node.kids:
            if isinstance(kid, list):
                parts.append(("".join(kid[0]), kid[1]))
            elif kid.skip != node.skip or kid.tag in BLOCK:
                if kid.tag in BLOCK:             # what is left out of a line does not break it
                    flush(parts)
                    parts.clear()
                inner: list = []
                visit(kid, inner)
                flush(inner)
            else:
                visit(kid, parts)
    parts: list = []
    visit(root, parts)
    flush(parts)
    return out


def _block_node(node):
    while node.parent is not None and node.tag not in BLOCK and not (
            node.skip and not node.parent.skip):
        node = node.parent
    return node


def path_of(node: Node) -> str:
    tags = []
    while node.parent is not None:
        tags.append(node.tag + ("~" if node.skip else ""))
        node = node.parent
    return "/".join(reversed(tags))


# --- wrappers -------------------------------------------------------------------
# A wrapper is a list of items [key, optional, repeated, payload]: the payload of an
# element or group is its list of items; that of a text, key '', is [print or None,
# pages that hold it (the TEMPLATE smallest prints), characters, of them in links].

def _print(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) << 32 | zlib.adler32(
        text.encode("utf-8", "replace"))


def wrapper_of(root: Node, page_print: int) -> list:
    """The wrapper of one page: its tokens with repeats found."""
    texts: dict = {}
    for node, text, linked in blocks_of(root):
        texts.setdefault(id(_block_node(node)), []).append(
            ["", False, False, [_print(text), [page_print], len(text), int(linked * len(text))]])

    def items(node):
        out, mine = [], texts.pop(id(node), [])
        for kid in node.kids:
            if isinstance(kid, list):
                if mine:
                    out.append(mine.pop(0))
            elif kid.tag in BLOCK or kid.skip != node.skip:
                out.append([kid.tag + ("~" if kid.skip else ""), False, False, items(kid)])
            else:                                   # inline: its text stands in the block around it
                if mine:
                    out.append(mine.pop(0))
        return squash(out + mine)
    return items(root)


def squash(items: list) -> list:
    """Runs of one token, then of several, that stand twice or more in a row become repeated."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merge_item(out[-1], item)
            out[-1][2] = True
        else:
            out.append(item)
    for q in range(2, min(8, len(out) // 2) + 1):
        i = 0
        while i + 2 * q <= len(out):
            keys = [x[0] for x in out[i:i + q]]
            group = None
            while i + 2 * q <= len(out) and [x[0] for x in out[i + q:i + 2 * q]] == keys:
                group = merge(group or out[i:i + q], out[i + q:i + 2 * q])
                del out[i + q:i + 2 * q]
            if group:
                out[i:i + q] = [["(" + " ".join(keys) + ")", False, True, group]]
            i += 1
    return generalise(out)


def generalise(items: list) -> list:
    """A level that is too long becomes a repeated group of optional tokens."""
    if len(items) <= LEVEL and not (len(items) > 1 and any(x[0] == "*" for x in items)):
        return items
    held: dict = {}
    for item in items:
        for x in (item[3] if item[0] == "*" else [item]):
            held[x[0]] = merge_item(held[x[0]], x) if x[0] in held else x
            held[x[0]][1] = True
    return [["*", True, True, [held[k] for k in sorted(held)]]]


def merge_item(a: list, b: list) -> list:
    if a[0] == "":
        x, y = a[3], b[3]
        load = [x[0] if x[0] == y[0] else None, sorted({*x[1], *y[1]})[:TEMPLATE], x[2] + y[2], x[3] + y[3]]
    else:
        load = merge(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2], load]


def _grouped(items: list, other: list) -> list:
    """``items`` with the single occurrences of groups that ``other`` repeats."""
    for group in [x for x in other if x[0][:1] == "("]:
        keys, i, out = [x[0] for x in group[3]], 0, []
        while i < len(items):
            if [x[0] for x in items[i:i + len(keys)]] == keys:
                out.append([group[0], False, False, items[i:i + len(keys)]])
                i += len(keys)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge(a: list, b: list) -> list:
    """Aligns two levels: equal tokens merge, the others become optional."""
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka == kb:
        return [merge_item(x, y) for x, y in zip(a, b)]
    if ka == ["*"] or kb == ["*"]:
        return generalise(a + b)
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(merge_item(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    # an optional token beside the same token is a repeat of it
    flat: list = []
    for x in out:
        if flat and flat[-1][0] == x[0]:
            flat[-1] = merge_item(flat[-1], x)
            flat[-1][2] = True
        else:
            flat.append(x)
    return generalise(flat)


def expression(items: list) -> str:
    """A wrapper as text: tags, fixed text as =, slots as #, with ? and + behind optional and repeated ones."""
    out = []
    for key, optional, repeated, load in items:
        if key == "":
            body = "#" if load[0] is None or len(load[1]) < TEMPLATE else "="
        elif key[0] in "(*":
            body = f"({expression(load)})"
        else:
            body = f"<{key}>{expression(load)}</>"
        mark = ("*" if optional else "+") if repeated else ("?" if optional else "")
        out.append(f"({body}){mark}" if mark and body[-1] != ")" else body + mark)
    return " ".join(out)


def fixed_texts(items: list) -> dict[str, int]:
    """Path -> print of the texts that the wrapper fixes."""
    out: dict = {}

    def visit(items, path):
        for key, _, _, load in items:
            if key == "":
                out.setdefault(path, []).append(load[0] if len(load[1]) >= TEMPLATE else None)
            elif key[0] in "(*":
                visit(load, path)
            else:
                visit(load, f"{path}/{key}" if path else key)
    visit(items, "")
    return {p: x[0] for p, x in out.items() if len(set(x)) == 1 and x[0] is not None}


# --- extraction -----------------------------------------------------------------

def main_text(page: str | None, fixed: dict) -> str:
    """The main text of a page, given the fixed texts of its host."""
    if not page:
        return ""
    root = parse(page)
    blocks, weight, count = [], {}, {}
    for node, text, linked in blocks_of(root):
        home = _block_node(node)
        template = bool(fixed) and fixed.get(path_of(home)) == _print(text)
        blocks.append((home, text, template))
        content = 0 if node.skip or template else int(len(text) * (1 - linked))
        up = home
        while up is not None:
            weight[id(up)] = weight.get(id(up), 0) + content
            up = up.parent
    if not weight.get(id(root)):          # a host of one text: nothing to tell template from content
        return main_text(page, {}) if fixed else ""
    region = _region(root, weight)
    inside: set = set()
    held = []
    for home, text, template in blocks:
        up = home
        while up is not None and up is not region and id(up) not in inside:
            up = up.parent
        if up is None or home.skip or (template and not (home.tag == "p" or _HEADING.match(home.tag))):
            continue
        inside.add(id(home))
        held.append(text)
    return "\n\n".join(held)


def _region(root, weight):
    for kind in ("article", "main"):
        best = None
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == kind and not node.skip and weight.get(id(node), 0) > (
                    weight[id(best)] if best is not None else 0):
                best = node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
        if best is not None:
            return best
    node = root
    while True:
        kids = [k for k in node.kids if isinstance(k, Node) and k.tag != "p" and not _HEADING.match(k.tag)]
        top = max(kids, key=lambda k: weight.get(id(k), 0), default=None)
        if top is None or 10 * weight.get(id(top), 0) < 6 * weight[id(node)]:
            return node
        node = top


# --- Spark side -----------------------------------------------------------------

def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("text"))


def _dump(wrapper) -> bytes:
    return zlib.compress(json.dumps(wrapper, separators=(",", ":")).encode(), 1)


def _load(held: bytes):
    return json.loads(zlib.decompress(held))


PARTIAL = "host string, wrapper binary, pages long, part int"


def _infer(batches):
    for batch in batches:
        for part in text_slices(batch):
            held, pages = {}, {}
            for host, page in zip(part.column("host").to_pylist(), part.column("text")):
                page = page.as_py() or ""
                mine = wrapper_of(parse(page), _print(page))
                held[host] = merge(held[host], mine) if host in held else mine
                pages[host] = pages.get(host, 0) + 1
            yield ship(host=pa.array(held, pa.string()), wrapper=binary([_dump(w) for w in held.values()]),
                       pages=pa.array(pages.values(), pa.int64()),
                       part=pa.array([zlib.crc32(_dump(w)) & 0x7FFFFFFF for w in held.values()], pa.int32()))


def _merge_group(table: pa.Table) -> pa.Table:
    """One wrapper of the group's wrappers, whatever their order."""
    held = sorted(zip(table.column("wrapper").to_pylist(), table.column("pages").to_pylist()))
    out = None
    for w, _ in held:
        out = _load(w) if out is None else merge(out, _load(w))
    done = _dump(out)
    return pa.table({"host": table.column("host")[:1].cast(pa.string()), "wrapper": binary([done]),
                     "pages": pa.array([sum(n for _, n in held)], pa.int64()),
                     "part": pa.array([zlib.crc32(done) & 0x7FFFFFFF], pa.int32())})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the inferred wrapper of every host, packed."""
    partial = written(_pages(pages).mapInArrow(_infer, PARTIAL), "wrappers")
    while True:
        most = partial.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return partial.select("host", "wrapper", "pages")
        groups = -(-most // FAN)
        partial = written(partial.groupBy("host", F.pmod("part", F.lit(groups)).alias("g"))
                          .applyInArrow(_merge_group, PARTIAL), "wrappers")


def wrapper_expressions(pages: DataFrame) -> DataFrame:
    """(host, pages, expression): the wrappers as readable union-free expressions."""
    def run(batches):
        for batch in batches:
            yield ship(host=batch.column("host"), pages=batch.column("pages"), expression=pa.array(
                [expression(_load(w)) for w in batch.column("wrapper").to_pylist()], pa.string()))
    return wrappers(pages).mapInArrow(run, "host string, pages long, expression string")


def _fixed(batches):
    for batch in batches:
        yield ship(host=batch.column("host"), fixed=binary(
            [_dump(fixed_texts(_load(w))) for w in batch.column("wrapper").to_pylist()]))


def _extract(batches):
    known: dict = {}
    for batch in batches:
        for part in text_slices(batch):
            out = []
            for page, fixed in zip(part.column("text"), part.column("fixed")):
                key = fixed.as_py()
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = _load(key) if key else {}
                out.append(main_text(page.as_py(), known[key]))
            yield ship(page_id=part.column("page_id"), url=part.column("url"),
                       text=pa.array(out, pa.string()), n_chars=pa.array(list(map(len, out)), pa.int64()))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    fixed = written(wrappers(pages).mapInArrow(_fixed, "host string, fixed binary"), "wrapper-texts")
    size = fixed.agg(F.sum(F.length("fixed") + F.length("host"))).first()[0] or 0
    rows = _pages(pages)
    joined = rows.join(small(fixed) if size <= BROADCAST_BYTES else fixed, "host", "left")
    kinds = dict(pages.dtypes)
    return written(joined.select("page_id", "url", "text", "fixed").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long"), "page-texts")
