"""The part of extraction that needs a real tree: main text, text blocks, microdata, RDFa, scripted controls.

Spark splits the pages; this helper sees one document at a time inside an Arrow batch.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.functions.markup import HIDDEN_MARK
from crawlscope.session import small_batches

# Tag sets and markers of the main-text rule.
SKIP = frozenset("script style noscript template svg iframe canvas object embed select option head title meta link".split())
BLOCK = frozenset(
    "p div section article main li ul ol h1 h2 h3 h4 h5 h6 table thead tbody tr td th blockquote pre dl dt dd figure figcaption form "
    "header footer address br hr details summary aside nav body".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside".split())
CHROME_ROLES = frozenset("navigation contentinfo complementary dialog alertdialog".split())
CHROME_WORDS = {"id": ("cookie", "consent", "onetrust"), "class": ("cookie", "consent", "gdpr", "newsletter-popup")}
HIDDEN_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
# Tags a new block closes when they are still open.
CLOSES_P = frozenset("p div ul ol dl table section article aside nav header footer main h1 h2 h3 h4 h5 h6 form pre blockquote figure hr address".split())
SAME_LEVEL = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
# Fixed value: how scripts name the address they go to.
NAV_TARGET = re.compile(
    r"(?:location(?:\.href)?\s*=|location\.assign\(|location\.replace\(|window\.open\(|navigate\(|router\.push\(|goto\()\s*['\"`]([^'\"`]+)['\"`]", re.I
)
SCHEMA_ORG = re.compile(r"^https?://schema\.org/", re.I)

#: Documents that a worker holds at once, with what it finds in them.
BATCH = 128

#: Types of the facts.
FIELDS = {
    "blocks": "array<string>", "method": "string", "confidence": "string", "items": "array<struct<format:string,type:string,props:map<string,string>>>",
    "item_paths": "array<map<string,string>>", "controls": "array<struct<text:string,target:string>>",
}
FACTS = tuple(FIELDS)
TEXT_FACTS, ITEM_FACTS = frozenset(("blocks", "method", "confidence")), frozenset(("items", "item_paths"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "hidden")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.hidden = bool(attrs) and _hidden(attrs)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)
        self.nodes, self.names = [self.root], set()  # every node, and the names of all attributes

    def handle_starttag(self, tag, attrs):
        close = SAME_LEVEL.get(tag, ()) or (("p",) if tag in CLOSES_P else ())
        if close and self.here.tag in close:
            self.here = self.here.parent
        own: dict[str, str] = {}
        for key, value in attrs:
            own.setdefault(key, value or "")
        if own:
            self.names.update(own)
        node = Node(tag, own, self.here)
        self.nodes.append(node)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


#: Blanks that `split` doesn't know.
_BLANKS = re.compile("[ ​‌‍﻿]")


def _norm(s: str) -> str:
    return " ".join((s if s.isascii() else _BLANKS.sub(" ", s)).split())


def _hidden(attrs: dict[str, str]) -> bool:
    if HIDDEN_MARK in attrs or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    style = attrs.get("style", "").lower()
    return bool(style) and any(s in style for s in HIDDEN_STYLES)


def _chrome(n: Node) -> bool:
    if n.tag in CHROME_TAGS:
        return True
    a = n.attrs
    return bool(a) and (a.get("role") in CHROME_ROLES or any(k in a and any(w in a[k].lower() for w in ws) for k, ws in CHROME_WORDS.items()))


def _keep(n: Node) -> bool:
    return not n.hidden and n.tag not in ("script", "style", "noscript", "template")


def _blocks(root: Node, body_root: bool) -> list[str]:
    """Text blocks below `root`, cut at block elements; chrome inside the root is left out."""
    out: list[str] = []
    buf: list[str] = []

    def flush():
        text = _norm("".join(buf))
        if text:
            out.append(text)
        buf.clear()

    stack = [iter(root.children)]
    closing = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if closing.pop():
                flush()
        elif isinstance(child, str):
            buf.append(child)
        elif _keep(child) and not _chrome(child) and child.tag not in SKIP:
            if body_root and child.parent is root and (child.tag == "header" or child.attrs.get("role") == "banner"):
                continue
            block = child.tag in BLOCK
            if block:
                flush()
            stack.append(iter(child.children))
            closing.append(block)
    flush()
    return out


def _visible(root: Node) -> str:
    out, stack = [], [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif _keep(item) or item is root:
            stack.extend(reversed(item.children))
    return _norm("".join(out))


def _shown(root: Node):
    """Nodes in order that neither are hidden nor lie in hidden ones."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.hidden:
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def main_text(root: Node) -> tuple[list[str], str, str]:
    """(blocks, method, confidence) of the primary content."""
    body, mains, articles = None, [], []
    for n in _shown(root):
        if n.tag == "body":
            body = body or n
        elif n.tag == "article":
            articles.append(n)
        if n.tag == "main" or n.attrs.get("role") == "main":
            mains.append(n)
    body = body or root
    target, method = (mains[0], "landmark:main") if mains else (articles[0], "landmark:article") if len(articles) == 1 else (body, "body")
    blocks = _blocks(target, target is body)
    size = len("\n".join(blocks))
    everything = len(_visible(body)) if size < 200 else 0  # only little text is held against the rest
    if method != "body" and size < 200 and everything > size * 4 + 400:
        return _blocks(body, True), "body (landmark nearly empty)", "low"
    low = size < 80 and everything > 600
    return blocks, method, "low" if low else "medium" if method == "body" else "high"


def _item_value(n: Node) -> str:
    for key in ("content", "href", "src", "datetime"):
        if key in n.attrs:
            return _norm(n.attrs[key])
    return _norm(n.text())


def _kind(raw: str, prefix: re.Pattern) -> str:
    return prefix.sub("", (raw.split() or [""])[0])


def _items(root: Node) -> tuple[list[dict], list[dict]]:
    """Microdata and RDFa items with their own properties; and, in the same order, what nested items add to each by dotted name.

    One walk from the top carries the items around a node with the dotted name so far, and the vocabulary.
    """
    found: list[tuple[str, str, dict]] = []
    plain = re.compile("^schema:", re.I)
    stack = [(root, [], [], "")]
    while stack:
        n, micro, rdfa, vocab = stack.pop()
        a = n.attrs
        vocab = a.get("vocab", vocab)
        for name, scope, kind, around, prefix in (("itemprop", "itemscope", "itemtype", micro, SCHEMA_ORG), ("property", "typeof", "typeof", rdfa, plain)):
            key = prefix.sub("", a[name].split()[0]) if a.get(name, "").split() else ""
            if key and around:
                value = f"@{prefix.sub('', a.get(kind, ''))}" if scope in a else _item_value(n)
                for props, path in around:
                    props[(*path, key)] = value
            if scope in a:
                props: dict[tuple, str] = {}
                inside = [(props, ()), *((p, (*path, key)) for p, path in around if key)]
                if name == "itemprop":
                    micro = inside
                    if "itemtype" in a and "itemprop" not in a:
                        found.append(("Microdata", _kind(a["itemtype"], SCHEMA_ORG), props))
                else:
                    rdfa = inside
                    if "property" not in a and ("schema.org" in vocab.lower() or a["typeof"].strip().lower().startswith("schema:")):
                        found.append(("RDFa", _kind(a["typeof"], plain), props))
        stack.extend((c, micro, rdfa, vocab) for c in reversed(n.children) if isinstance(c, Node))
    own = [{"format": f, "type": t, "props": {k[0]: v for k, v in p.items() if len(k) == 1}} for f, t, p in found]
    return own, [{".".join(k): v for k, v in p.items() if len(k) > 1} for _, _, p in found]


#: Attributes without which there are no items, and no controls.
ITEM_MARKS = frozenset(("itemscope", "typeof"))
TARGETS = ("data-href", "data-url", "data-link", "routerlink")
CONTROL_MARKS = frozenset((*TARGETS, "onclick"))  # a role alone names no target


def _controls(root: Node) -> list[dict]:
    """Elements that navigate by script or data attribute and have no link around or inside them."""
    around, holds = set(), set()
    for n in root.walk():
        if n.parent is not None and id(n.parent) in around or n.tag == "a" and "href" in n.attrs:
            around.add(id(n))
        if n.tag == "a" and "href" in n.attrs:
            for p in n.ancestors():
                if id(p) in holds:
                    break
                holds.add(id(p))
    out = []
    for n in root.walk():
        a = n.attrs
        if CONTROL_MARKS.isdisjoint(a):
            continue
        if id(n) in around or id(n) in holds:
            continue
        found = NAV_TARGET.search(a.get("onclick", ""))
        target = next((a[k] for k in TARGETS if k in a), found.group(1) if found else None)
        if target:
            out.append({"text": _norm(n.text()), "target": target})
    return out


def read_document(html: str | None, only: tuple[str, ...] = FACTS) -> dict:
    """Tree facts of a document, or those named in `only`."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    out = {}
    if not TEXT_FACTS.isdisjoint(only):
        out["blocks"], out["method"], out["confidence"] = main_text(builder.root)
    if not ITEM_FACTS.isdisjoint(only):
        out["items"], out["item_paths"] = ([], []) if ITEM_MARKS.isdisjoint(builder.names) else _items(builder.root)
    if "controls" in only:
        out["controls"] = [] if CONTROL_MARKS.isdisjoint(builder.names) else _controls(builder.root)
    # Parents and children hold each other, so a tree would stay until the collector runs, which it does the more rarely the more results there are.
    for node in builder.nodes:
        node.parent, node.children = None, []
    return out


def document_facts(html: Column, *only: str) -> Column:
    """Tree facts of a document, or those named, as a struct column (Arrow batches of few rows, no shuffle)."""
    small_batches(BATCH)
    wanted = tuple(f for f in FACTS if f in only) if only else FACTS

    @F.arrow_udf(f"struct<{','.join(f'{f}:{FIELDS[f]}' for f in wanted)}>")
    def parse(batch: pa.Array) -> pa.Array:
        return pa.array([_as_arrow(read_document(h, wanted)) for h in batch.to_pylist()], type=_arrow_type(wanted))

    return parse(html)


def profile_trees(rows: DataFrame) -> DataFrame:
    """`raw_tree` and `dom_tree` of `facts.genuine_documents`."""
    rows = rows.withColumns({"raw_tree": document_facts(F.col("html")), "_own": document_facts(F.col("dom"))})
    return rows.withColumn("dom_tree", F.when(F.col("_same"), F.col("raw_tree")).otherwise(F.col("_own"))).drop("_own")


def _as_arrow(found: dict) -> dict:
    """Maps as lists of pairs."""
    if found.get("items"):
        found["items"] = [{**i, "props": list(i["props"].items())} for i in found["items"]]
        found["item_paths"] = [list(p.items()) for p in found["item_paths"]]
    return found


def _arrow_type(wanted: tuple[str, ...]) -> pa.DataType:
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    types = {
        "blocks": pa.list_(text), "method": text, "confidence": text, "items": pa.list_(pa.struct([("format", text), ("type", text), ("props", pairs)])),
        "item_paths": pa.list_(pairs), "controls": pa.list_(pa.struct([("text", text), ("target", text)])),
    }
    return pa.struct([(f, types[f]) for f in wanted])
