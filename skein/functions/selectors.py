"""A small selector matcher for page fingerprints: tag, .class, #id and one descendant."""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from skein.functions.html import VOID
from skein.functions.text import col

#: Selectors tried in order for each purpose (fixed values of this library).
PURPOSES = {"main": ("main", "article", "#content", ".content", "body p"), "title": ("h1", ".title", "title"), "list": ("ul li", "ol li", ".item")}
PRINT = "array<struct<purpose:string,selector:string,hash:string,sample:string>>"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []
        self.nodes: list[list] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        node = [tag, (a.get("class") or "").split(), a.get("id"), [n[:3] for n in self.open], []]
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for node in self.open:
            node[4].append(data)


def _fits(part: str, node) -> bool:
    return part[1:] in node[1] if part[0] == "." else node[2] == part[1:] if part[0] == "#" else node[0] == part


def select(html: str, selector: str) -> list[str]:
    """Texts of the nodes that a selector meets."""
    tree = _Tree()
    tree.feed(html or "")
    *outer, last = selector.split()
    return [" ".join("".join(n[4]).split()) for n in tree.nodes if _fits(last, n) and all(any(_fits(o, up) for up in n[3]) for o in outer)]


def _prints(s: pd.Series) -> pd.Series:
    def one(html):
        out = []
        for purpose, selectors in PURPOSES.items():
            for selector in selectors:
                texts = [t for t in select(html, selector) if t]
                if texts:
                    sample = " ".join(texts)[:200]
                    out.append({"purpose": purpose, "selector": selector, "hash": hashlib.sha256(sample.encode()).hexdigest(), "sample": sample})
                    break
        return out

    return s.map(one)


def fingerprints(html: str | Column) -> Column:
    """For each purpose the first selector with text, a 200-character sample and its hash."""
    return pandas_udf(_prints, PRINT)(col(html))
