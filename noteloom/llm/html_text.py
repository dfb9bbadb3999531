"""Operator 2: main text by wrapper induction.

Pages of a host share a template. One page of each host (the smallest hashed page_id, not the whole group) lends its tree;
every other page of the host is aligned with it by simple tree matching, on trees whose like siblings share slots. Sums
over all aligned pages, formed within tasks before they meet, say for each slot how many characters vary from page to page,
how many of them stand in links, and which texts recur. They decide what is kept:

* the content root is the lowest slot that holds most of the varying text outside links, with the page's title line;
* a text that recurs in its slot on nearly all pages is template, whatever its element;
* a slot whose text is links is a menu.

Pages of hosts with fewer pages are aligned with one page of all hosts whose pages have the same containers. Tags, roles,
class names and ids are evidence beside that: what they call a menu, footer, sidebar, notice, advert, form or comment has
no say in the content root and goes, unless it holds nearly all that varies; marked articles are preferred to a slot around
them. Where too few pages align, the page's own marks and masses of text decide. A page counts, where texts recur, by the share
of its text that varies from the tree's page: near copies of that page say little of what is template, copies nothing, and a
page that is mostly template as much as any other of its host.

A block's white space (Unicode's) becomes one space; inline elements and `br` do not end a block.

Nulls: a null html is empty and gives '' with 0 characters; a null url, or one without a host, belongs to the host ''.
Rows with null page_id are kept. Repeated rows stay rows. A very long page is read whole. Of slots with equal masses the
first on the page is taken. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<more2>[^>]*)>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that their own kind ends, with what bounds the search for an open one.
ENDS_SELF = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that show nothing of a page's text.
UNSEEN = frozenset("canvas head noscript object script select style svg template".split())
DROP_TAGS = frozenset("aside button dialog footer form menu nav".split())
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog navigation search".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption".split())
LISTS = frozenset("ul ol menu nav div section table dl".split())
#: Slots that like containers of one parent have; those beyond share the last. Plain elements share one.
SLOTS = 8
#: Share of the aligned pages' weight with the same text that makes it template, and the fewest such pages.
CONSTANT, PAGES = 0.9, 4
#: Share of varying text that the next node on the way to the content root holds, and share of links in a menu.
HOLDS, LINKS = 0.6, 0.8
#: Share of the varying text that marks leave at least, and the steps that the weight of a page is counted in.
LEAVE, STEPS = 0.3, 1000
#: Evidence that an element is no content, the strongest first; what is hidden is none in any case.
NONE, TAG, NAME, HIDDEN = range(4)


class Node:
    __slots__ = ("tag", "key", "mark", "parent", "children", "text")

    def __init__(self, tag: str, key: str, mark: int, parent: Node | None):
        self.tag, self.key, self.mark, self.parent = tag, key, mark, parent
        self.children: list[Node] = []
        self.text: list[tuple[int, str, bool]] = []  # (number of the block on the page, piece, in a link)


def parse(page: str) -> Node:
    """The tree of a page's block elements. Pieces of text carry the number of the block that they belong to; a node's mark
    is the evidence (TAG, NAME) that it is no content, or HIDDEN."""
    root = here = Node("#", "#", NONE, None)
    block, at, link = 0, 0, False
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            here.text.append((block, entities.unescape(piece) if "&" in piece else piece, link))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                link = False
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                if tag not in INLINE:
                    block += 1
                here = up.parent
            continue
        if tag == "br":
            here.text.append((block, " ", link))
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "a":
            link = True
        if tag == "body":  # ends a head that was left open
            while here.tag not in ("#", "html"):
                here = here.parent
        if tag in ENDS_P:
            up = here
            while up is not None and up.tag != "p":
                up = up.parent if up.tag in INLINE else None
            if up is not None:
                here = up.parent
        if tag == "hr":
            block += 1
            continue
        if tag in ENDS_SELF:
            stop, like, up = ENDS_SELF[tag].split(), SAME.get(tag, (tag,)), here
            while up is not None and up.tag not in stop and up.tag not in like:
                up = up.parent
            if up is not None and up.tag in like:
                here = up.parent
        more = m["more"] or m["more2"] or ""
        names, mark = "", HIDDEN if tag in UNSEEN else TAG if tag in DROP_TAGS or tag == "header" and not in_article(here) else NONE
        if "=" in more or "hidden" in more:
            for k, v in ATTRIBUTE.findall(more):
                k, v = k.lower(), v.strip("\"'").lower()
                if k in ("class", "id"):
                    names += "." + re.sub(r"\d+", "#", v)
                    if any(x in DROP_NAMES for x in re.split(r"[^a-z0-9]+", v)):
                        mark = mark or NAME
                elif k == "role":
                    mark = mark or (NAME if v in DROP_ROLES else NONE)
                elif k == "hidden" and v != "until-found" or k == "aria-hidden" and v == "true":
                    mark = HIDDEN
        if tag in INLINE:
            if not mark:
                continue
        else:
            block += 1
        node = Node(tag, tag + names, mark, here)
        here.children.append(node)
        if not more.endswith("/") or tag not in ("svg", "path"):
            here = node
    if at < len(page):
        here.text.append((block, entities.unescape(page[at:]), link))
    return root


def in_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def own_text(node: Node) -> tuple[int, int, int]:
    """The checksum (never 0) of a node's own text without its elements', its characters, and those of them in links."""
    if not node.text:
        return 0, 0, 0
    words = " ".join("".join(t for _, t, _ in node.text).split())
    linked = sum(len(t) for _, t, a in node.text if a)
    return (zlib.crc32(words.encode("utf-8", "replace")) + 1 if words else 0), len(words), min(len(words), linked)


class Fold:
    """A tree whose like siblings share slots; lists by slot, parents before children."""

    def __init__(self, root: Node):
        self.members: list[list[Node]] = [[root]]
        self.keys, self.kids = [root.key], [[]]
        at = 0
        while at < len(self.members):
            slots: dict[tuple, list[Node]] = {}
            for m in self.members[at]:
                seen: dict[str, int] = {}
                for c in m.children:
                    if c.mark == HIDDEN:
                        continue
                    if c.tag in PLAIN:
                        slots.setdefault((0, c.key), []).append(c)
                    else:
                        seen[c.key] = n = min(seen.get(c.key, 0) + 1, SLOTS)
                        slots.setdefault((1, c.key, n), []).append(c)
            # plain slots in a fixed order, then containers as they come
            for slot in sorted((k for k in slots if not k[0])) + [k for k in slots if k[0]]:
                self.kids[at].append(len(self.members))
                self.members.append(slots[slot])
                self.keys.append(slot[1])
                self.kids.append([])
            at += 1


def match(a: tuple[list[str], list[list[int]]], b: tuple[list[str], list[list[int]]]) -> dict[int, int]:
    """Simple tree matching of two trees (keys, children): the nodes of `a` with their partners in `b`."""
    keys_a, kids_a = a
    keys_b, kids_b = b
    best: dict[tuple[int, int], int] = {}

    def aligned(i: int, j: int) -> list[tuple[int, int]]:
        """The in-order matching of children with the largest sum."""
        ka, kb = kids_a[i], kids_b[j]
        table = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for p in range(len(ka) - 1, -1, -1):
            row, below = table[p], table[p + 1]
            for q in range(len(kb) - 1, -1, -1):
                w = best.get((ka[p], kb[q]), 0)
                row[q] = max(below[q], row[q + 1], w and w + below[q + 1])
        out, p, q = [], 0, 0
        while p < len(ka) and q < len(kb):
            w = best.get((ka[p], kb[q]), 0)
            if w and table[p][q] == w + table[p + 1][q + 1]:
                out.append((ka[p], kb[q]))
                p, q = p + 1, q + 1
            elif table[p][q] == table[p + 1][q]:
                p += 1
            else:
                q += 1
        return out

    order, todo = [], [(0, 0)] if keys_a and keys_b and keys_a[0] == keys_b[0] else []
    while todo:  # parents before children, so that sums can be formed backwards
        pair = todo.pop()
        order.append(pair)
        by_key: dict[str, list[int]] = {}
        for y in kids_b[pair[1]]:
            by_key.setdefault(keys_b[y], []).append(y)
        todo.extend((x, y) for x in kids_a[pair[0]] for y in by_key.get(keys_a[x], ()))
    for pair in reversed(order):
        best[pair] = 1 + sum(best[p] for p in aligned(*pair))
    out, todo = {}, order[:1]
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo.extend(aligned(i, j))
    return out


def skeleton(page: str) -> str:
    """A page's slots as JSON: keys, children, marks, members and checksums of own texts."""
    f = Fold(parse(page))
    texts = [sorted({h for h, _, _ in map(own_text, x) if h}) for x in f.members]
    return json.dumps([f.keys, f.kids, [x[0].mark for x in f.members], [len(x) for x in f.members], texts])


def load(reference: str) -> list:
    """A skeleton with its texts as sets."""
    out = json.loads(reference)
    return [*out[:4], [set(x) for x in out[4]], set().union(*out[4])]


def compared(page: str, reference: list) -> list[tuple[int, int, int, int, int, int]]:
    """What a page tells of the reference's slots, as (slot, text, weight, characters, in links, varying outside links) with
    text 0, and (slot, text, weight, 0, 0, 0) for each text of the slot that the page repeats. The weight is the share of the
    page's text that the reference does not have, in `STEPS`; a copy has none and tells nothing."""
    f = Fold(parse(page))
    texts = [[x for x in map(own_text, m) if x[0]] for m in f.members]
    chars = sum(n for x in texts for _, n, _ in x)
    new = sum(n for x in texts for h, n, _ in x if h not in reference[5])
    if not new:
        return []
    weight = max(1, STEPS * new // chars)
    out = []
    for i, j in match((reference[0], reference[1]), (f.keys, f.kids)).items():
        own = reference[4][i]
        varying = sum(n - a for h, n, a in texts[j] if h not in own)
        out.append((i, 0, weight, sum(n for _, n, _ in texts[j]), sum(a for _, _, a in texts[j]), varying))
        out.extend((i, h, weight, 0, 0, 0) for h in {h for h, _, _ in texts[j]} & own)
    return out


def descend(keys: list[str], kids: list[list[int]], marks: list[int], sizes: list[int], mass: list[int], trust: int, prefer: float | None) -> int:
    """The content root: down from the root to the child that holds most of the mass outside what marks take away, as long
    as no title is left behind. Marked articles that hold `prefer` of its mass are preferred to it: the one that holds most
    of theirs, or else the node around them."""
    n = len(keys)
    held, title = list(mass), [keys[i].split(".")[0] in ("h1", "h2") and mass[i] > 0 for i in range(n)]
    for i in range(n - 1, -1, -1):  # children stand behind their parents
        for k in kids[i]:
            if not NONE < marks[k] <= trust:
                held[i] += held[k]
                title[i] = title[i] or title[k]
    root = 0
    while kids[root]:
        able = [k for k in kids[root] if not NONE < marks[k] <= trust]
        heavy = max(able, key=lambda k: held[k], default=None)
        if heavy is None or keys[heavy].split(".")[0] in PLAIN or sizes[heavy] > 1 or held[heavy] < HOLDS * max(held[root], 1) or any(title[k] for k in able if k != heavy):
            break
        root = heavy
    if prefer is not None:
        todo, marked = [(root, root)], []
        while todo:
            i, above = todo.pop()
            if keys[i].split(".")[0] in ("article", "main"):
                marked.append((i, above))
            else:
                todo.extend((k, i) for k in reversed(kids[i]) if not NONE < marks[k] <= trust)
        total = sum(held[i] for i, _ in marked)
        if total and total >= prefer * held[root]:
            i, above = max(marked, key=lambda x: held[x[0]])
            return i if held[i] >= HOLDS * total else above
    return root


def trusted(kids: list[list[int]], marks: list[int], mass: list[int], leave: float) -> int:
    """How far marks may be trusted: what they leave is more than nothing and at least the share `leave` of the mass."""
    total = sum(mass)
    for trust in (NAME, TAG):
        left, todo = 0, [0]
        while todo:
            i = todo.pop()
            left += mass[i]
            todo.extend(k for k in kids[i] if not NONE < marks[k] <= trust)
        if left and left >= leave * total:
            return trust
    return NONE


def wrapper(reference: list, sums: list[tuple[int, int, int, int, int, int, int]], evidence: bool = True) -> dict:
    """Content root, template texts and menus from (slot, text, pages, weight, characters, in links, varying outside links)."""
    keys, kids, marks, sizes = reference[:4]
    n = len(keys)
    pages, weights, chars, links, mass, same = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, []
    for i, text, count, weight, c, a, v in sums:
        if text:
            same.append((i, text, count, weight))
        else:
            pages[i], weights[i], chars[i], links[i], mass[i] = count, weight, c, a, v
    trust = trusted(kids, marks, mass, LEAVE) if evidence else NONE
    root = descend(keys, kids, marks, sizes, mass, trust, HOLDS if evidence else None)
    for i in range(n - 1, -1, -1):
        for k in kids[i]:
            chars[i] += chars[k]
            links[i] += links[k]
    menus = [i for i in range(n) if pages[i] >= PAGES and keys[i].split(".")[0] in LISTS and i != root and links[i] >= LINKS * chars[i] > 0]
    template: dict[int, list[int]] = {}
    for i, text, count, weight in same:
        if count >= PAGES and weight >= CONSTANT * weights[i]:
            template.setdefault(i, []).append(text)
    return {"keys": keys, "kids": kids, "root": root, "menus": menus, "template": sorted(template.items()), "trust": trust, "seen": pages[0]}


def main_text(page: str, w: dict | None, evidence: bool = True) -> str:
    """The blocks of a page's content, joined by line feeds."""
    tree = parse(page)
    f = Fold(tree)
    gone, constant, tops = set(), set(), []
    if w is not None and w["seen"] >= PAGES:
        trust = w["trust"]
        partner = match((w["keys"], w["kids"]), (f.keys, f.kids))
        if w["root"] in partner:
            tops = f.members[partner[w["root"]]]
        gone = {id(m) for i in w["menus"] if i in partner for m in f.members[partner[i]]}
        constant = {id(m) for i, texts in w["template"] if i in partner for m in f.members[partner[i]] if own_text(m)[0] in texts}
    if not tops:  # too few pages, or one that has no such root: its own marks and masses decide
        mass = []
        for x in f.members:
            got = list(map(own_text, x))
            mass.append(sum(n - a for _, n, a in got))
        marks = [x[0].mark for x in f.members]
        trust = trusted(f.kids, marks, mass, 0) if evidence else NONE
        tops = f.members[descend(f.keys, f.kids, marks, [len(x) for x in f.members], mass, trust, 0 if evidence else None)]
    blocks: dict[int, list[str]] = {}
    todo = list(reversed(tops))
    first = set(map(id, tops))
    while todo:
        n = todo.pop()
        if n.mark == HIDDEN or id(n) not in first and (NONE < n.mark <= trust or id(n) in gone):
            continue
        if id(n) not in constant:
            for number, t, _ in n.text:
                blocks.setdefault(number, []).append(t)
        todo.extend(reversed(n.children))
    lines = (" ".join("".join(blocks[k]).split()) for k in sorted(blocks))
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def containers(html: Column) -> Column:
    """A number that pages with the same containers (and class names, without digits) share."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:div|section|article|main|nav|aside|header|footer|table|form)\b[^>]*>"), F.lit(0))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(F.lower(t), r"\d+", "#")))))


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and two keys of each row: its host's and its containers'."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.concat(F.lit("h"), host_of(F.col("url"))).alias("host"), html.alias("html"))
    return rows.withColumn("shape", F.concat(F.lit("s"), F.hex(containers(F.col("html")))))


def with_both(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """`rows` with the table's entry of the host, or else of the containers."""
    for key in ("host", "shape"):
        rows = rows.join(table.filter(F.col("key").startswith(key[0])).select(F.col("key").alias(key), F.col(name).alias(f"{name}_{key}")), key, "left")
    return rows.withColumn(name, F.coalesce(f"{name}_host", f"{name}_shape")).withColumn("key", F.when(F.col(f"{name}_host").isNotNull(), F.col("host")).otherwise(F.col("shape")))


def wrappers(rows: DataFrame) -> DataFrame:
    """(key, wrapper as JSON) for each host with more than `PAGES` pages, and for each set of containers with as many."""
    rows = rows.withColumn("pick", F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    keys = F.explode(F.array("host", "shape")).alias("key")
    first = materialize(rows.select(keys, "pick").groupBy("key").agg(F.min("pick").alias("pick"), F.count("*").alias("n")).filter(F.col("n") > PAGES).drop("n"), "keys")
    chosen = rows.select(keys, "pick", "html").join(first, ["key", "pick"]).dropDuplicates(["key"])

    def skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f.key, "reference": [skeleton(x) for x in f.html]})

    references = materialize(chosen.select("key", "html").mapInPandas(skeletons, "key string, reference string"), "references")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list[int]] = {}
        loaded: dict[str, list] = {}
        send = lambda: pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["key", "slot", "text", "pages", "weight", "chars", "links", "varying"])
        for f in frames:
            for key, page, reference in zip(f.key, f.html, f.reference):
                if key not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[key] = load(reference)
                for i, text, *own in compared(page, loaded[key]):
                    t = total.setdefault((key, i, text), [0, 0, 0, 0, 0])
                    t[0] += 1
                    for k, x in enumerate(own, 1):
                        t[k] += x
            if len(total) > 200_000:
                yield send()
                total.clear()
        yield send()

    joined = with_both(rows.select("host", "shape", "html"), references, "reference").filter("reference IS NOT NULL").select("key", "html", "reference")
    counted = joined.mapInPandas(sums, "key string, slot int, text long, pages long, weight long, chars long, links long, varying long").groupBy("key", "slot", "text").agg(*[F.sum(x).alias(x) for x in ("pages", "weight", "chars", "links", "varying")])
    gathered = counted.groupBy("key").agg(F.collect_list(F.struct("slot", "text", "pages", "weight", "chars", "links", "varying")).alias("sums"))  # as many as the reference page has slots and texts

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f.key, "wrapper": [json.dumps(wrapper(json.loads(r), sorted(tuple(x) if not isinstance(x, dict) else tuple(x.values()) for x in s))) for r, s in zip(f.reference, f.sums)]})

    return materialize(references.join(gathered, "key").mapInPandas(build, "key string, wrapper string"), "wrappers")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    rows = keyed(pages)
    found = with_both(rows, wrappers(rows), "wrapper").select("page_id", "url", "html", "wrapper")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, dict] = {}
        for b in batches:
            out = []
            for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w is not None and w not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[w] = json.loads(w)
                out.append(main_text(page, None if w is None else loaded[w]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
