"""Main text of web pages by wrapper induction.

Pages of a host are DOM trees with runs of like siblings folded into one node. Trees are aligned by
simple tree matching and merged into one template per host: in every task first, then between
tasks, so any number of pages is covered and what travels is one small tree per host and task. A
node whose text stays the same over the pages is template, a node whose text varies is a slot. The
wrapper of a host is the path of the slot region that holds most of the varying text, without what
the page itself declares to be something else (navigation, forms, adverts, comments and the like).
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .batches import send_small_batches
from .reputation import url_host

SALTS = 32  # first round of merging a host's templates
DEEPEST = 200  # depth of a template; in it, what is nested deeper belongs to the node there, pages are read at any depth
SIBLINGS = 200  # children of a template node that are told apart if they are not on all pages; rarer ones share a slot
SLOT = ". "  # ends the label of a slot; no class or id has white space

# Elements by role in the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEADED = set("head title meta link base".split())
SKIPPED = set(
    "script style template noscript head title nav header footer aside button select option textarea input iframe object "
    "svg canvas audio video map dialog menu fieldset datalist xmp noembed noframes math".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption hgroup search".split()
)
# A start tag that ends open elements of these names, up to the nearest container.
ENDS_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "dd", "dt", "li"} | {"menu"}
ENDS = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tr"},
}
CONTAINERS = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "main", "body", "html", "blockquote", "nav", "aside"}
# Words of class, id and role that name parts other than the article.
ROLES = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar side aside widget widgets share sharing social related recommended comment comments disqus reply replies respond discussion "
    "toolbar pagination pager search complementary contentinfo".split()
)
# Words that say where such a part stands or how it looks, beside a word of ``ROLES`` in one name.
PLACES = set(
    "left right top bottom upper lower first last inner outer site page global main primary secondary box area block bar panel wrapper "
    "container wrap section list item items link links unit slot zone inline wide text content mobile desktop fixed sticky post entry "
    "blog user google".split()
)
ARTICLE_NAMES = {"article", "main"}
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[a-zA-Z]+")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    """An element; ``parts`` are its texts and elements in page order."""

    name: str
    label: str
    other: bool  # declared to be no part of an article
    parts: list = field(default_factory=list)


def names_part(value: str) -> bool:
    """Whether one of the names in a class, id or role is that of a part, with nothing else in it: sidebar-left, not has-sidebar."""
    for name in value.split():
        found = WORD.findall(name)
        if ROLES.intersection(found) and all(word in ROLES or word in PLACES for word in found):
            return True
    return False


def declared(name: str, attributes: str) -> tuple[str, bool]:
    """The label of an element for alignment (name, first class word or id), and whether it is set apart."""
    if not attributes:
        return name, name in SKIPPED
    label, other = name, name in SKIPPED
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            other = True
        elif key != "aria-hidden" and value:
            if name not in ("html", "body", *ARTICLE_NAMES) and names_part(value):
                other = True
            if key == "class" or label == name:
                label = f"{name}.{DIGITS.sub('#', value.split()[0])}" if value.split() else label
    return label, other


def set_forms_apart(root: Node) -> None:
    """Set forms apart, but for those round an article or main element or round most of the page's text."""
    order, at = [root], 0
    while at < len(order):
        order += [part for part in order[at].parts if not isinstance(part, str)]
        at += 1
    if not any(node.name == "form" for node in order):
        return
    chars: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for node in reversed(order):
        below = [part for part in node.parts if not isinstance(part, str) and not part.other]
        chars[id(node)] = sum(len(part) for part in node.parts if isinstance(part, str)) + sum(chars[id(part)] for part in below)
        holds[id(node)] = node.name in ARTICLE_NAMES or any(holds[id(part)] for part in below)
    for node in order:
        if node.name == "form" and not holds[id(node)] and 2 * chars[id(node)] <= chars[id(root)]:
            node.other = True


def parse(page: str) -> Node:
    """The DOM of ``page``; unclosed elements end where the standard says or at the end of their parent."""
    root = Node("html", "html", False)
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()  # names on the stack, so that it is searched for those only

    def close(depth: int) -> None:
        opened.subtract(x.name for x in stack[depth:])
        del stack[depth:]

    while at < n:
        tag = TAG.search(page, at)
        if not tag:
            break
        if tag.start() > at:
            stack[-1].parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if not opened[name]:
                    break
                if stack[depth].name == name:
                    close(depth)
                    break
            continue
        if name == "html":
            continue
        if name == "body" or (stack[-1].name == "head" and name not in HEADED | RAW | {"noscript", "template"}):
            while len(stack) > 1 and stack[-1].name == "head":
                close(len(stack) - 1)
        if name in ENDS_P or name in ENDS:
            gone = ENDS.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for depth in range(len(stack) - 1, 0, -1):
                if not any(opened[g] for g in gone):
                    break
                if stack[depth].name in gone:
                    close(depth)
                elif stack[depth].name in CONTAINERS:
                    break
        label, other = declared(name, tag[3])
        node = Node(name, label, other)
        stack[-1].parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = end.start() if end else n
        stack.append(node)
        opened[name] += 1
    rest = page[at:]
    if rest:
        cut = re.search(r"<[/!?]?[a-zA-Z!?][^>]*$", rest)  # a tag that never ends
        stack[-1].parts.append(rest[: cut.start()] if cut else rest)
    set_forms_apart(root)
    return root


def words(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks under ``node`` in page order, without elements that are set apart."""
    out, line = [], []

    def end() -> None:
        text = words("".join(line))
        line.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif part.other and part is not node:
            if part.name in BLOCKS:
                end()
            elif part.name == "br":
                line.append(" ")
        elif part.name == "br":
            line.append(" ")
        elif part.name in BLOCKS:
            end()
            todo.append(None)
            todo += reversed(part.parts)
        else:
            todo += reversed(part.parts)
    end()
    return out


# --- templates: [label, pages, text hash or "*", characters, set apart, children] ---


def folded(node: Node) -> list:
    """The tree of ``node`` with runs of like siblings as one node, and hash and size of the texts of its own."""
    texts: dict[int, list[str]] = {}
    todo, top = [node], [node.label, 1, "", 0, node.other, []]
    holders = {id(node): (top, 0)}
    while todo:
        current = todo.pop()
        here, depth = holders[id(current)]
        for part in current.parts:
            if isinstance(part, str):
                if part and not part.isspace():
                    texts.setdefault(id(here), []).append(part)
            elif part.name in BLOCKS or part.other or part.name in ("br", "img"):
                if part.name in VOID:
                    continue
                if depth == DEEPEST:
                    if not part.other:
                        holders[id(part)] = here, depth
                        todo.append(part)
                    continue
                like = next((c for c in here[5] if c[0] == part.label), None)
                if like is None:
                    like = [part.label, 1, "", 0, part.other, []]
                    here[5].append(like)
                holders[id(part)] = like, depth + 1
                todo.append(part)
            else:  # inline elements belong to the text around them
                holders[id(part)] = here, depth
                todo.append(part)

    def finish(tree: list) -> None:
        stack = [tree]
        while stack:
            t = stack.pop()
            own = "".join(texts.get(id(t), []))
            t[2] = xxhash.xxh64_hexdigest(own.encode("utf-8", "surrogatepass"))[:12] if own else ""
            t[3] = len(own)
            stack += t[5]

    finish(top)
    return top


def matched(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and the matched children."""
    if a[0] != b[0]:
        return 0, []
    left, right = a[5], b[5]
    if not left or not right:
        return 1, []
    if [c[0] for c in left] == [c[0] for c in right]:
        return 1 + sum(matched(x, y)[0] for x, y in zip(left, right, strict=True)), [(i, i) for i in range(len(left))]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    size = [[matched(x, y)[0] for y in right] for x in left]
    for i in range(len(left)):
        for j in range(len(right)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size[i][j])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if size[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + size[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs[::-1]


def merge(a: list, b: list) -> list:
    """The template of two templates of equal label: matched nodes are merged, others are kept in order."""
    pairs = matched(a, b)[1]
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[5]), len(b[5]))]:
        children += a[5][i:x] + b[5][j:y]
        if x < len(a[5]) and y < len(b[5]):
            children.append(merge(a[5][x], b[5][y]))
        i, j = x + 1, y + 1
    pages = a[1] + b[1]
    plain = [c for c in children if not c[0].endswith(SLOT)]
    if len(plain) > SIBLINGS:
        least = sorted((c[1] for c in plain), reverse=True)[SIBLINGS - 1]
        if sum(c[1] >= least for c in plain) > SIBLINGS and least < pages:
            least += 1
        children = slotted(children, least)
    elif len(plain) < len(children):
        children = slotted(children, 0)
    same = a[2] == b[2]
    return [a[0], pages, a[2] if same else "*", a[3] + b[3], a[4] and b[4], children]


def slotted(children: list, least: int) -> list:
    """``children`` with those on fewer than ``least`` pages merged into one slot for each element name, at the end.

    Parts that are set apart have slots of their own, so that they do not hide or join the others.
    """
    kept, slots = [], {}
    for c in children:
        if c[0].endswith(SLOT) or c[1] < least:
            label = c[0] if c[0].endswith(SLOT) else f"{c[0].split('.')[0]}{'.other' * c[4]}{SLOT}"
            c = [label, *c[1:]]
            slots[label] = merge(slots[label], c) if label in slots else c
        else:
            kept.append(c)
    return kept + [slots[label] for label in sorted(slots)]


def rare_slotted(template: list) -> list:
    """The children of a node for choosing a wrapper: labels on less than half of its pages are slots, if there are several."""
    rare = Counter((c[0].split(".")[0], c[4]) for c in template[5] if 2 * c[1] < template[1])
    single = [c for c in template[5] if 2 * c[1] >= template[1] or rare[c[0].split(".")[0], c[4]] < 2]
    return single + slotted([c for c in template[5] if not any(c is s for s in single)], template[1])


def wrapper_of(template: list) -> list:
    """Steps from the root to the node that holds the article: labels, or of a slot [element name, labels that are not in it].

    From the root down, the child with most varying text is entered while it holds over two thirds of
    what varies below. A node that says it is the article is taken where it holds most of it. With one
    page nothing varies: then all text counts.
    """
    alone = template[1] < 2

    def varying(t: list, sure: bool = True) -> int:
        """Characters that vary; what is on fewer pages than its parent does."""
        if t[4]:
            return 0
        own = t[3] if alone or t[2] == "*" or not sure else 0
        return own + sum(varying(c, sure and c[1] >= t[1]) for c in t[5])

    path, here = [template[0]], template
    while True:
        here = [*here[:5], here[5] if alone else rare_slotted(here)]
        if here[0].split(".")[0] in ARTICLE_NAMES:
            inner = [c for c in here[5] if c[0].split(".")[0] in ARTICLE_NAMES and not c[4]]
            if not inner:
                return path
        live = [c for c in here[5] if not c[4]]
        named = [c for c in live if c[0].split(".")[0] in ARTICLE_NAMES]
        total = varying(here)
        size = lambda c: varying(c, c[1] >= here[1])  # noqa: E731, B023
        best = max(named or live, key=size, default=None)
        if best is None or total == 0 or size(best) < (0.34 if named else 0.67) * total:
            return path
        if best[0].split(".")[0] in BLOCKS - {"div", "section", "article", "main", "body", "table", "tbody", "tr", "td", "center"}:
            return path  # a paragraph is no region
        if best[0].endswith(SLOT):
            name = best[0].split(".")[0]
            path.append([name, sorted(c[0] for c in here[5] if c[0].split(".")[0] == name and not c[0].endswith(SLOT))])
        else:
            path.append(best[0])
        here = best


def located(root: Node, path: list[str]) -> list[Node]:
    """The nodes of a page at ``path``; where a step is missing, an article or the last node found."""
    here = [root]
    for label in path[1:]:
        below, todo = [], [p for n in reversed(here) for p in reversed(n.parts) if not isinstance(p, str)]
        while todo:
            node = todo.pop()
            fits = node.label == label if isinstance(label, str) else node.name == label[0] and node.label not in label[1]
            if fits and not node.other:
                below.append(node)
            elif node.name not in BLOCKS and not node.other:
                todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
        if not below:
            return articles(root) or here
        here = below
    return here


def articles(root: Node) -> list[Node]:
    """The outermost nodes that say they are the article, not set apart."""
    found, todo = {"article": [], "main": []}, [root]
    while todo:
        node = todo.pop()
        if node.name in found:
            found[node.name].append(node)
            continue
        if not node.other:
            todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return found["article"] or found["main"]


def main_text(page: str | None, path: list[str] | None) -> str:
    if not page:
        return ""
    root = parse(page)
    regions = located(root, path) if path else [root]
    blocks = [b for region in regions for b in blocks_of(region)]
    if not any(r.name in ARTICLE_NAMES for r in regions):  # a page may be clearer than the wrapper of its host
        own = [b for r in regions for article in articles(r) for b in blocks_of(article)]
        if 2 * sum(map(len, own)) >= sum(map(len, blocks)):
            blocks = own
    return "\n".join(blocks)


def merged_templates(rows: list[tuple[str, int, str]]) -> dict[str, list]:
    """host -> template of the (host, order, template) rows, merged in their order."""
    out: dict[str, list] = {}
    for host, _, text in sorted(rows):
        tree = json.loads(text)
        out[host] = merge(out[host], tree) if host in out else tree
    return out


TEMPLATES = StructType([StructField("host", StringType()), StructField("at", LongType()), StructField("template", StringType())])


def host_templates(pages: DataFrame) -> DataFrame:
    """host, template: the merged tree of all pages of each host; equal pages of a task count once."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        templates: dict[str, list] = {}
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            rows = [(h, part, json.dumps(t)) for h, t in templates.items()]
            templates.clear()
            seen.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], TEMPLATES.names
            )

        for batch in batches:
            for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
                name, value = host.as_py(), page.as_py()
                if not value:
                    continue
                digest = xxhash.xxh64_intdigest(f"{name} {value}".encode("utf-8", "surrogatepass"))
                if digest in seen:
                    continue
                seen.add(digest)
                tree = folded(parse(value))
                templates[name] = merge(templates[name], tree) if name in templates else tree
            if len(templates) > 20_000 or len(seen) > 500_000:
                yield flush()
        yield flush()

    def join(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in TEMPLATES.names), strict=True))
        found = merged_templates(rows)
        first = min(at for _, at, _ in rows)
        return pa.table(
            [pa.array(list(found), pa.string()), pa.array([first] * len(found), pa.int64()), pa.array([json.dumps(t) for t in found.values()])],
            names=TEMPLATES.names,
        )

    parts = pages.mapInArrow(induce, TEMPLATES)
    for keys in (["host", F.pmod("at", F.lit(SALTS)).alias("salt")], ["host"]):
        parts = parts.groupBy(*keys).applyInArrow(join, TEMPLATES)
    return parts.select("host", "template")


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) with ``text``, the main text, and ``n_chars``.

    Blocks are joined by a line feed; white space in a block is one space; character references are
    decoded. A null or empty html gives an empty text. Pages without a host share one wrapper. Every
    row is kept, repeated or not, an empty table gives no rows, and columns of the input named like a
    new one are replaced.
    """
    send_small_batches(pages.sparkSession)
    hosted = pages.withColumn("_host", url_host(F.col("url")))

    def wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [json.dumps(wrapper_of(json.loads(t.as_py()))) for t in batch.column("template")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["_host", "_path"])

    templates = host_templates(hosted.select(F.col("_host").alias("host"), "html"))
    paths = cut_lineage(templates.mapInArrow(wrappers, "_host string, _path string"))

    @F.pandas_udf(StringType())
    def text_of(html_: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, json.loads(p) if p else None) for h, p in zip(html_, path, strict=True)], dtype=object)

    joined = hosted.join(paths, "_host", "left")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    return joined.select(*kept, text_of("html", "_path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
