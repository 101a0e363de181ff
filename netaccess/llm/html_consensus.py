"""Main-text extraction by consensus host paths.

Every page scores its containers and votes with the generalised tag-class path of its best one; votes are
summed by host in Spark; paths with at least ``MIN_SHARE`` of their host's votes win, and each page is
extracted again from the first winning path that it has. A page with none of them uses its own best.

Elements that only pages have around their text (menus, forms, hidden ones and the like) are left out for sure. A class or
id is weak evidence: only a whole name made of page-part words counts ("cookie-notice", not "side-effects"), it lowers what
its text is worth to a tenth in the scores, and its element is left out of a winning container but may be one itself, if
the score or the host's votes say so. Inside an article, headings, its header and named sections are text.

Attributes are read from left to right and compared by whole names. Null and empty pages give an empty text;
long pages are read whole, in time and memory that grow with their length however deep they nest. Ties between paths go to the lesser path, ties between containers
to the first in the page. Repeated pages vote again and give equal texts. A url without host votes under the
empty host. Empty tables give an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from netaccess.llm.common import map_arrow
from netaccess.runtime import broadcast_if_small, materialize

MIN_SHARE = 0.1
HOST_BROADCAST_ROWS = 200_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>|<[/a-zA-Z][^>]*\Z""", re.DOTALL)
#: One attribute after another, so that a name is only ever read where a name stands, never inside a value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# fixed values: element names by their role in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object select title".split())
#: Of these what follows an open one that never ends is page again, as no browser takes it for their text.
MARKUP = frozenset("noscript template svg object select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body html td th blockquote".split())
JUNK_TAGS = frozenset("head nav header footer aside form button dialog menu input label".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
JUNK_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar side aside widget widgets related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot comment comments commentlist disqus reply replies respond discussion share sharing social toolbar pagination pager login search hidden tracking alert".split())
#: Words that say nothing beside one of those: "site-header", "sidebar-left", "related-posts".
NEUTRAL_WORDS = frozenset("a the box block wrap wrapper container content area bar list items item section panel inner outer left right top bottom main primary secondary site page global sticky fixed slot unit units row col column group links link buttons button form field input icon icons media posts post articles article stories thread threads count wall bar text body".split())
#: Names that a section of an article may well have.
TOPIC_WORDS = frozenset("notice notices side related recommended recommendations header banner respond discussion share sharing social search tracking alert reply replies hidden promotion consent subscription menu navigation".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = frozenset("p blockquote pre li dt dd td th figcaption caption span b i em strong a hgroup".split())
PLACE_WORDS = frozenset("header masthead topbar footer foot sidebar side aside".split())
#: What text under a weak name is worth in the scores.
WEAK_WORTH = 0.1
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
SPLIT_NAME = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def name_words(value: str) -> list[str]:
    return [w for w in SPLIT_NAME.split(CAMEL.sub("-", value).lower()) if w]


def is_junk(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether the element is none of a text by its kind."""
    if tag in JUNK_TAGS:
        return not (tag == "header" and in_article)
    if not attrs or tag in ("html", "body"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in JUNK_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def is_weak(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether a class or the id, as a whole, names a part of a page that is no text."""
    if not attrs or tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    names = [(v, True) for v in attrs.get("class", "").split()] + [(attrs.get("id", ""), False)]
    for value, is_class in names:
        words = [w.rstrip("0123456789") or "a" for w in name_words(value)]
        junk = [w for w in words if w in JUNK_WORDS]
        if not junk or any(w not in JUNK_WORDS and w not in NEUTRAL_WORDS for w in words):
            continue
        if tag in TEXT_TAGS and words[-1] in PLACE_WORDS:
            continue  # a paragraph may be called header; only a container is one
        if in_article and (tag == "section" or not is_class) and all(w in TOPIC_WORDS for w in junk):
            continue
        return True
    return False


class Node:
    __slots__ = ("article", "children", "junk", "parent", "step", "tag", "weak")

    def __init__(self, tag: str, parent: Node | None, step: str, junk: bool, weak: bool):
        self.tag, self.parent, self.step, self.junk, self.weak, self.children = tag, parent, step, junk, weak, []
        self.article = tag in ("article", "main") or (parent is not None and parent.article)

    @property
    def path(self) -> str:
        """The generalised steps of the block elements down to this one."""
        steps, up = [], self
        while up.parent is not None:
            if up.tag in BLOCK:
                steps.append(up.step)
            up = up.parent
        return ">".join(reversed(steps))


def parse(page: str) -> Node:
    """A tree of nodes and texts; tolerates unclosed, stray and cut-off tags. Raw elements are left out."""
    root = node = Node("", None, "", False, False)
    at = 0
    open_tags: dict[str, int] = {}
    endless: set[str] = set()

    def leave(upto: Node) -> Node:
        nonlocal node
        while node is not upto:
            open_tags[node.tag] -= 1
            node = node.parent
        return node

    find = TAG.search
    while m := find(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if not open_tags.get(tag):
                continue
            up = node
            while up.parent is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                leave(up.parent)
            continue
        if tag in VOID:
            node.children.append(" ")
            continue
        if tag in RAW and not m[4]:
            end = ENDS[tag].search(page, at) if tag not in endless else None
            if end is None:
                endless.add(tag)
            at = end.end() if end else at if tag in MARKUP else len(page)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            up = node
            while up.parent is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                leave(up.parent)
        if tag in SIBLINGS and any(open_tags.get(t) for t in SIBLINGS[tag]):
            up = node
            while up.parent is not None and up.tag not in SIBLINGS[tag] and up.tag not in SCOPE - SIBLINGS[tag]:
                up = up.parent
            if up.tag in SIBLINGS[tag]:
                leave(up.parent)
        attrs = attributes(m[3])
        classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
        inside = node.article
        new = Node(tag, node, ".".join([tag, *classes]), node.junk or is_junk(tag, attrs, inside), is_weak(tag, attrs, inside))
        node.children.append(new)
        if not m[4]:
            node = new
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        node.children.append(page[at:])
    return root


def blocks(top: Node, weak_too: bool = False) -> list[tuple[Node, str, int, Node | None, bool]]:
    """Text blocks under a node in page order: (nearest block element, text, characters inside links, outermost list, under a weak name).

    Without ``weak_too`` what stands under a weak name below ``top`` is left out.
    """
    out: list[tuple[Node, list[str], int, Node | None, bool]] = []
    held: list[str] = []
    linked = 0

    def close(owner: Node, listed: Node | None, weak: bool) -> None:
        nonlocal held, linked
        if held:
            out.append((owner, held, linked, listed, weak))
            held, linked = [], 0

    stack: list[tuple[Node, Node, int, bool, Node | None, bool]] = [(top, top, 0, False, None, False)]
    while stack:
        node, owner, k, in_link, listed, weak = stack.pop()
        children = node.children
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, str):
                held.append(child)
                linked += len(child.strip()) * in_link
            elif not child.junk and (weak_too or not child.weak):
                stack.append((node, owner, k, in_link, listed, weak))
                if child.tag in BLOCK:
                    close(owner, listed, weak)
                    stack.append((child, child, 0, in_link, child if listed is None and child.tag in ("ul", "ol") else listed, weak or child.weak))
                else:
                    stack.append((child, owner, 0, in_link or child.tag == "a", listed, weak or child.weak))
                break
        else:
            if node.tag in BLOCK or node is top:
                close(owner, listed, weak)
    return [(owner, text, n, listed, weak) for owner, parts, n, listed, weak in out if (text := " ".join(html_module.unescape("".join(parts)).split()))]


def page_text(top: Node) -> str:
    """Blocks of a container joined by line ends. A list of links alone is a menu if no other text of the
    container stands before it; once text has begun, lists belong to it, however long."""
    found = blocks(top)
    lists: dict[int, bool] = {}
    for _, text, linked, listed, _ in found:
        if listed is not None:
            lists[id(listed)] = lists.get(id(listed), True) and linked >= len(text) - text.count(" ")
    out, begun = [], False
    for _, text, _, listed, _ in found:
        if begun or listed is None or not lists[id(listed)]:
            begun = True
            out.append(text)
    return "\n".join(out)


def best_container(root: Node) -> tuple[Node | None, float]:
    """The container credited with most text outside links: all of its own blocks, half of its children's."""
    credit: dict[int, list] = {}
    for owner, text, linked, _, weak in blocks(root, weak_too=True):
        worth = max(0, len(text) - linked) * (WEAK_WORTH if weak else 1.0)
        if owner.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "dd", "dt"):
            owner = owner.parent
            while owner.parent is not None and owner.tag in ("ul", "ol", "tr", "tbody", "table", "dl", "blockquote", "p") or (owner.parent is not None and owner.tag not in BLOCK):
                owner = owner.parent
        for share in (1.0, 0.5, 0.25):
            if owner is None or owner.parent is None:
                break
            credit.setdefault(id(owner), [owner, 0.0])[1] += worth * share * (1.5 if owner.tag in ("article", "main") else 1.0)
            owner = owner.parent
    if not credit:
        return None, 0.0
    node, score = max(credit.values(), key=lambda c: c[1])
    up, weak = node, False
    while up is not None:
        if up.tag in ("article", "main") and not up.junk and not weak:
            return up, score
        weak |= up.weak
        up = up.parent
    return node, score


def matching(root: Node, path: str) -> list[Node]:
    """Outermost sound nodes at a generalised path, in page order."""
    out, stack, steps = [], [(root, 0)], path.split(">")
    while stack:
        node, k = stack.pop()
        if k == len(steps):
            out.append(node)
            continue
        for child in reversed(node.children):
            if isinstance(child, str) or child.junk:
                continue
            if child.tag not in BLOCK:
                stack.append((child, k))
            elif child.step == steps[k]:
                stack.append((child, k + 1))
    return out


def extract(page: str, paths: list[str]) -> str:
    root = parse(page)
    for path in paths:
        if texts := [t for n in matching(root, path) if (t := page_text(n))]:
            return "\n".join(texts)
    top, _ = best_container(root)
    return page_text(top if top is not None else root)


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first; votes are summed before any row leaves a page's task."""
    schema = StructType([StructField("host", StringType()), StructField("path", StringType()), StructField("votes", DoubleType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, value in zip(batch["host"].to_pylist(), batch["html"]):
                top, score = best_container(parse(value.as_py() or ""))
                if top is not None and score > 0:
                    votes[host, top.path] = votes.get((host, top.path), 0.0) + 1.0
            yield {"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": list(votes.values())}

    votes = map_arrow(pages.select("host", "html"), run, schema).groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = materialize(votes, "host-votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    winners = votes.join(totals, "host").filter(F.col("votes") >= MIN_SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.col("path").alias("path"))))
    return winners.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    narrow = narrow.withColumn("host", host)
    winners = broadcast_if_small(materialize(host_paths(narrow), "host-paths"), HOST_BROADCAST_ROWS)
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [extract(value.as_py() or "", paths or []) for value, paths in zip(batch["html"], batch["paths"].to_pylist())]
            yield {"page_id": batch["page_id"].to_pylist(), "url": batch["url"].to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_arrow(narrow.join(winners, "host", "left").select("page_id", "url", "html", "paths"), run, schema)
