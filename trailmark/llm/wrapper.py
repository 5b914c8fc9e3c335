"""HTML main-text extraction by wrapper induction.

Every page is parsed to its element tree, of which the skeleton is taken: block
elements with their classes, runs of like siblings as one node. A host's
prototypes are the skeletons that most of its different pages have, at most
``prototypes`` of those with ``least`` pages or more, and one in any case; each other skeleton of the host is aligned with them node
by node by simple tree matching and takes the slots of the one that it fits best,
so null, empty, odd pages and mixed layouts spoil nothing. A line that stands in
one slot on nearly all different pages that have this slot is template, and goes;
varying slots are content.

Varying menus, adverts and comments are no article either, and no alignment can
tell: elements (nav, footer, aside, form ...), roles and class names that say
nothing else are left out of what remains, and where article or main elements hold
a fifth of the text or more, so is all that stands outside the smallest node that
holds them.

Pages are never compared in pairs: matching works on the distinct skeletons of a
host, counts are combined before they are shuffled, so a host with a third of
all pages costs its distinct lines. Trees are walked without recursion; a level
of over ``WIDTH`` runs merges all its like siblings, so pages of any depth and
width take time in proportion to their nodes.

Defined results: null, empty and text-only html give the text there is (empty if
none); a null or odd url has the empty host; repeated rows are extracted each
and count once for the template;
an empty table gives an empty result; extra columns are not read; very long, deep and
wide pages are handled like others; unclosed tags,
comments and references at the end of cut pages are dropped or kept as HTML does.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailmark.llm.shared import lean, stage, table
from trailmark.llm.telephony import slices

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math canvas object audio video select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
BOXES = frozenset("article aside body center div fieldset footer form header main nav ol section table tbody tfoot thead ul".split())
APART = frozenset("nav footer aside head menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr "
    "hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
# What may stand beside such a word in a class name without changing its meaning.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons col column container content first form global group head header heading holder icon icons inner item items last left link links list main media outer "
    "page panel post posts primary right row secondary section site slot small sticky text thread title to top unit wrap wrapper".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANK = re.compile(r"\s+")
WIDTH, BOX_RUN = 64, 8
#: Why a node's text stands apart: its element or role; a class name or id; being inside a form. The last two are hints.
PLAIN, HINTED, IN_FORM = 1, 2, 4
MENU_ITEMS, LABEL_WORDS = 3, 2
MOST_PAIRS = 20_000


class Node:
    __slots__ = ("tag", "label", "apart", "children", "parent", "top", "depth", "at")

    def __init__(self, tag: str, label: str, apart: int, parent: Node | None):
        self.tag, self.label, self.apart, self.parent = tag, label, apart, parent
        self.children: list[Node] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.at = -1  # its node of the skeleton
        #: the outermost article or main element that the node is in
        self.top: Node | None = parent.top if parent is not None and parent.top is not None else self if tag in ("article", "main") else None


def says_apart(name: str) -> bool:
    """Whether a class name or id says that its element is no part of an article, and nothing else."""
    words = [w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w]
    words = [w.lower() for w in words if not w.isdigit()]
    return any(w in WORDS for w in words) and all(w in WORDS or w in BESIDE for w in words)


def traits(tag: str, raw: str, inside: bool) -> tuple[str, int]:
    """A node's label for matching, and why its text stands apart from the article (0: it does not)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}
    names = found.get("class", "").split()
    label = f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '0', n.lower()) for n in names))}" if names else tag
    apart = tag in APART or (tag == "header" and not inside) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    apart = apart or "display:none" in found.get("style", "").replace(" ", "").lower()
    why = PLAIN if apart else IN_FORM if tag == "form" else 0
    if not apart and tag not in ("html", "body", "main"):
        hints = [n for n in [*names, found.get("id", "")] if says_apart(n)]
        # of an article only the class of a comment says that it is none
        if hints if tag != "article" else any(set(re.split(r"[_-]+", n.lower())) & {"comment", "comments", "reply"} for n in hints):
            why |= HINTED
    return label, why


class Opened:
    """The open elements of a page while it is read, with what is asked about them at hand: every question takes the same time."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.by_tag = [root], [root], {}

    @property
    def node(self) -> Node:
        return self.stack[-1]

    def depth(self, tags) -> int:
        """The depth of the innermost open element of these tags; -1 without one."""
        return max((self.by_tag[t][-1].depth for t in tags if self.by_tag.get(t)), default=-1)

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag not in INLINE:
            self.blocks.append(node)

    def close(self, depth: int) -> None:
        """Close all elements of this depth or more."""
        while len(self.stack) > 1 and self.stack[-1].depth >= depth:
            node = self.stack.pop()
            self.by_tag[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()


def parse(text: str) -> tuple[Node, list[list]]:
    """The element tree and the blocks [text, node, link length] in page order, in time that grows as the page."""
    root = Node("#", "#", 0, None)
    opened, blocks, buffer, at = Opened(root), [], [], 0
    links = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            line = BLANK.sub(" ", "".join(x for x, _ in buffer)).strip()
            if line:
                blocks.append([line, buffer[0][1], links])
            buffer.clear()
        links = 0

    def write(chunk: str) -> None:
        nonlocal links
        if chunk:
            chunk = htmllib.unescape(chunk) if "&" in chunk else chunk
            buffer.append((chunk, opened.blocks[-1]))
            if opened.depth("a") > opened.blocks[-1].depth:
                links += len(chunk.strip())

    for m in iter(lambda: TOKEN.search(text, at), None):
        write(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # the page ends inside a tag
            break
        tag, end = m[2].lower(), bool(m[1])
        if not end and tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(text, at)
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                at = stop.end() if stop else len(text)
            continue
        if tag == "br":
            buffer.append((" ", opened.blocks[-1]))
            continue
        if end:
            found = opened.depth((tag,))
            if tag not in INLINE:
                flush()
                if found > 0:
                    opened.close(found)
            elif found > opened.blocks[-1].depth:
                opened.close(found)
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and opened.blocks[-1].tag == "p":
                opened.close(opened.blocks[-1].depth)
            if tag in SIBLINGS:
                scope = opened.depth(SCOPES.get(tag, ()))
                while (found := opened.depth(SIBLINGS[tag])) > scope and found > 0:
                    opened.close(found)
                    if opened.node.tag not in SIBLINGS[tag]:
                        break
        label, apart = traits(tag, m[3], opened.node.top is not None)
        # an article is not apart for standing in a form that holds the page
        above = opened.node.apart & ~IN_FORM if tag in ("article", "main") else opened.node.apart
        child = Node(tag, label, apart | above, opened.node)
        opened.node.children.append(child)
        if tag not in VOID and not (m[3].rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P):
            opened.push(child)
    else:
        write(text[at:])
    flush()
    return root, blocks


Skeleton = tuple[list[str], list[list[int]]]  # labels, and the children of each node; the root is node 0


def inner(node: Node) -> list[Node]:
    """The block elements below a node, through inline ones."""
    if all(c.tag not in INLINE for c in node.children):
        return node.children
    out, stack = [], [iter(node.children)]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif c.tag in INLINE:
            stack.append(iter(c.children))
        else:
            out.append(c)
    return out


def skeleton(root: Node) -> Skeleton:
    """The tree of block elements, with runs of siblings of one label as one node; sets ``at`` of each.

    Boxes that stand side by side are places of their own, unless they are many.
    """
    labels, children, queue = [root.label], [[]], [[root]]
    root.at = 0
    for i, members in enumerate(queue):  # grows as it is walked
        below = [c for m in members for c in inner(m)]
        runs: list[list[Node]] = []
        for c in below:
            if runs and runs[-1][0].label == c.label:
                runs[-1].append(c)
            else:
                runs.append([c])
        runs = [part for run in runs for part in ([run] if run[0].tag not in BOXES or len(run) > BOX_RUN else [[c] for c in run])]
        if len(runs) > WIDTH:
            merged: dict[str, list[Node]] = {}
            for run in runs:
                merged.setdefault(run[0].label, []).extend(run)
            runs = list(merged.values())
        for run in runs:
            for c in run:
                c.at = len(labels)
            children[i].append(len(labels))
            labels.append(run[0].label)
            children.append([])
            queue.append(run)
    return labels, children


def written(found: Skeleton) -> str:
    up = [-1] * len(found[0])
    for i, below in enumerate(found[1]):
        for c in below:
            up[c] = i
    return "\n".join(f"{p} {label}" for p, label in zip(up, found[0]))


def read(text: str) -> Skeleton:
    rows = [x.split(" ", 1) for x in text.split("\n")]
    children: list[list[int]] = [[] for _ in rows]
    for i, (p, _) in enumerate(rows):
        if i:
            children[int(p)].append(i)
    return [x[1] for x in rows], children


def tree_match(a: Skeleton, b: Skeleton, most_pairs: int = MOST_PAIRS) -> dict[int, int]:
    """Simple tree matching: the most nodes of ``a``, with their partners in ``b``, parents and order kept.

    Levels of over ``WIDTH`` by ``WIDTH`` runs have lost their order: there like labels pair in turn. So they do below
    the pairs that follow the first ``most_pairs``, which bounds the work on pages that are unlike at many levels.
    """
    (la, ca), (lb, cb) = a, b
    if la[0] != lb[0]:
        return {}

    def by_label(i: int, j: int) -> list[tuple[int, int]]:
        turn: dict[str, list[int]] = {}
        for y in reversed(cb[j]):
            turn.setdefault(lb[y], []).append(y)
        return [(x, turn[la[x]].pop()) for x in ca[i] if turn.get(la[x])]

    def wide(i: int, j: int) -> bool:
        return len(ca[i]) * len(cb[j]) > WIDTH * WIDTH

    # equal subtrees match whole: nothing below them need be compared
    known: dict[tuple, int] = {}

    def kinds(found: Skeleton) -> tuple[list[int], list[int]]:
        kind, size = [0] * len(found[0]), [1] * len(found[0])
        for i in range(len(found[0]) - 1, -1, -1):  # children have larger numbers
            kind[i] = known.setdefault((found[0][i], *(kind[c] for c in found[1][i])), len(known))
            size[i] += sum(size[c] for c in found[1][i])
        return kind, size

    (ka, sizes), (kb, _) = kinds(a), kinds(b)
    in_turn: dict[tuple[int, int], list[tuple[int, int]]] = {}
    pairs = [(0, 0)]
    for i, j in pairs:  # grows as it is walked: all pairs of like, unequal nodes below pairs
        if ka[i] == kb[j]:
            continue
        if wide(i, j) or len(pairs) > most_pairs:
            in_turn[i, j] = by_label(i, j)
        pairs += in_turn.get((i, j)) or [(x, y) for x in ca[i] for y in cb[j] if la[x] == lb[y]]
    weight: dict[tuple[int, int], int] = {}

    def table_of(i: int, j: int) -> list[list[int]]:
        best = [[0] * (len(cb[j]) + 1)]
        for x in ca[i]:
            above, row = best[-1], [0]
            for n, y in enumerate(cb[j]):
                row.append(max(above[n + 1], row[n], above[n] + weight.get((x, y), 0)))
            best.append(row)
        return best

    for i, j in reversed(pairs):
        if ka[i] == kb[j]:
            weight[i, j] = sizes[i]
        elif (i, j) in in_turn:
            weight[i, j] = 1 + sum(weight[p] for p in in_turn[i, j])
        else:
            weight[i, j] = 1 + (table_of(i, j)[-1][-1] if ca[i] and cb[j] else 0)
    out, open_ = {}, [(0, 0)]
    while open_:
        i, j = open_.pop()
        out[i] = j
        if ka[i] == kb[j]:
            open_ += zip(ca[i], cb[j])
            continue
        if (i, j) in in_turn:
            open_ += in_turn[i, j]
            continue
        best, m, n = table_of(i, j), len(ca[i]), len(cb[j])
        while m and n:
            if best[m][n] == best[m - 1][n]:
                m -= 1
            elif best[m][n] == best[m][n - 1]:
                n -= 1
            else:
                m, n = m - 1, n - 1
                open_.append((ca[i][m], cb[j][n]))
    return out


def article(text: str, outside_share: float = 3.0) -> tuple[list[list], Node]:
    """The article's blocks as [line, holder], and the root of the tree.

    The article is the smallest node that holds all text of article and main elements; a page with over
    ``outside_share`` times their text outside of them is kept whole. Where only hints (class names, forms) would leave
    no text at all, they are not believed.
    """
    root, blocks = parse(text)
    for reasons in (PLAIN | HINTED | IN_FORM, PLAIN | HINTED, PLAIN):
        kept = [x for x in blocks if not x[1].apart & reasons]
        if kept:
            break
    # outside of articles a list is a menu if its items are mostly links and are many, or labels of a word or two
    items: dict[int, list[int]] = {}
    linked = lambda line, holder, links: holder.top is None and holder.tag == "li" and 2 * links > len(line)
    for x in kept:
        if linked(*x):
            items.setdefault(id(x[1].parent), []).append(len(x[0].split()))
    menus = {k for k, words in items.items() if len(words) >= MENU_ITEMS or max(words) <= LABEL_WORDS}
    kept = [[x[0], x[1]] for x in kept if not (linked(*x) and id(x[1].parent) in menus)]
    tops = [holder.top for _, holder in kept if holder.top is not None]
    inside = sum(len(line) for line, holder in kept if holder.top is not None)
    outside = sum(len(line) for line, holder in kept if holder.top is None)
    if tops and outside_share * inside >= outside:
        # the first and the last in page order: what holds both holds all between
        whole, top = tops[0], tops[-1]
        while whole is not top:
            if whole.depth >= top.depth:
                whole = whole.parent
            else:
                top = top.parent
        below, stack = set(), [whole]
        while stack:
            node = stack.pop()
            below.add(node)
            stack += node.children
        kept = [x for x in kept if x[1] in below]
    return kept, root


def host_of(column: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


BLOCKS = "page_id long, url string, host string, page_code long, layout long, skeleton string, blocks array<struct<text:string,node:int,code:bigint>>"
BLOCK = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("code", pa.int64())]))


def code_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_blocks(text: str) -> tuple[str, list[dict]]:
    """The skeleton of a page, and its article's blocks with their nodes there."""
    kept, root = article(text)
    found = written(skeleton(root))
    out = []
    for line, holder in kept:
        while holder.at < 0:  # text right inside inline elements
            holder = holder.parent
        out.append({"text": line, "node": holder.at, "code": code_of(line)})
    return found, out


def slots(layout: int, own: str, models: list[dict]) -> list[int]:
    """A slot for each node of a skeleton: that of its partner in the prototype that it fits best, or a name of its own."""
    mine, best = read(own), None
    for m in models:
        if m["layout"] == layout:
            best = (2.0, layout, {i: i for i in range(len(mine[0]))})
            break
        other = read(m["skeleton"])
        pairs = tree_match(mine, other)
        fit = 2 * len(pairs) / (len(mine[0]) + len(other[0]))
        if best is None or fit > best[0]:
            best = (fit, m["layout"], pairs)
    out, up = [], [0] * len(mine[0])
    for i, below in enumerate(mine[1]):
        for c in below:
            up[c] = i
    chain: list[int] = []
    for i, label in enumerate(mine[0]):
        chain.append(code_of(f"{chain[up[i]] if i else 0} {label}"))
        out.append(code_of(f"{best[1]}/{best[2][i]}") if best and i in best[2] else chain[i])
    return out


def extract(pages: DataFrame, *, share: float = 0.9, least: int = 5, prototypes: int = 4) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A line is template if it stands in one slot on ``share`` of a host's different
    pages that have the slot, of which there are ``least`` or more.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))

    def run(batches):
        for b in slices(batches, 2):
            rows = [page_blocks(text) for text in b.column(2).to_pylist()]
            code = [code_of("\n".join(x["text"] for x in r)) for _, r in rows]
            columns = [pa.array(code, pa.int64()), pa.array([code_of(s) for s, _ in rows], pa.int64()), pa.array([s for s, _ in rows], pa.string()), pa.array([r for _, r in rows], BLOCK)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *columns], ["page_id", "url", "host", "page_code", "layout", "skeleton", "blocks"])

    def align(batches):
        for b in batches:
            found = [slots(*x) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["host", "layout", "slots"])

    rows = stage(pages.select("page_id", "url", "html", "host").mapInArrow(lean(run), BLOCKS), "html-blocks")
    layouts = rows.select("host", "layout", "page_code", "skeleton").dropDuplicates(["host", "layout", "page_code"])
    layouts = stage(layouts.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.first("skeleton").alias("skeleton")), "html-layouts")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout"))
    models = layouts.withColumn("rank", rank).where(F.col("rank") <= prototypes).where((F.col("rank") == 1) | ((F.col("rank") <= prototypes) & (F.col("pages") >= least))).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "layout", "skeleton"))).alias("models"))
    placed = stage(layouts.join(models, "host").select("host", "layout", "skeleton", "models").mapInArrow(lean(align), "host string, layout long, slots array<bigint>"), "html-slots")

    lines = rows.select("host", "page_code", "layout", F.explode("blocks").alias("x")).select("host", "layout", "page_code", "x.node", "x.code").distinct()
    lines = lines.join(placed, ["host", "layout"]).select("host", F.expr("slots[node]").alias("slot"), "page_code", "code").distinct()
    different = lines.select("host", "slot", "page_code").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    lines = lines.groupBy("host", "slot", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * least)
    lines = lines.join(different, ["host", "slot"]).where(F.col("n") >= share * F.col("pages"))
    nodes = placed.select("host", "layout", F.posexplode("slots").alias("node", "slot")).join(lines.select("host", "slot", "code"), ["host", "slot"])
    template = stage(nodes.groupBy("host", "layout").agg(F.collect_set(F.struct("node", "code")).alias("template")), "html-template")
    out = rows.join(template, ["host", "layout"], "left")
    kept = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x: ~F.array_contains(F.col("template"), F.struct(x["node"].alias("node"), x["code"].alias("code")))))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op7_wrapper_induction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
