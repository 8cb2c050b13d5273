"""Tree edit similarity of HTML tables, after the published definition: 1 - edit distance / nodes of the larger tree."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are nodes; cells carry text and spans.
NODES = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")


class _Tree(HTMLParser):
    """Postorder labels (tag, spans, text) and leftmost leaves of the first table of a text."""

    def __init__(self):
        super().__init__()
        self.open: list[list] = []
        self.labels: list[tuple[str, str, str]] = []
        self.left: list[int] = []
        self.done = False

    def handle_starttag(self, tag, attrs):
        if tag in NODES and not self.done and (self.open or tag == "table"):
            a = dict(attrs)
            self.open.append([tag, f"{a.get('rowspan') or 1}x{a.get('colspan') or 1}" if tag in ("td", "th") else "", "", len(self.labels)])

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("td", "th"):
            self.open[-1][2] += data

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while True:
                name, span, text, first = self.open.pop()
                self.labels.append((name, span, " ".join(text.split())))
                self.left.append(first)
                if name == tag:
                    break
            self.done |= not self.open

    @classmethod
    def of(cls, text: str) -> _Tree:
        t = cls()
        t.feed(text or "")
        while t.open:
            t.handle_endtag(t.open[-1][0])
        return t


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _rename(a: tuple, b: tuple) -> float:
    if a[:2] != b[:2]:
        return 1.0
    longest = max(len(a[2]), len(b[2]))
    return _levenshtein(a[2], b[2]) / longest if longest else 0.0


def similarity(a: str, b: str) -> float:
    """0 to 1; 0 where either text has no table."""
    s, t = _Tree.of(a), _Tree.of(b)
    n, m = len(s.labels), len(t.labels)
    if not n or not m:
        return 0.0
    keyroots = lambda left: sorted({x: i for i, x in enumerate(left)}.values())
    dist = np.zeros((n, m))
    for i in keyroots(s.left):
        for j in keyroots(t.left):
            a0, b0 = s.left[i], t.left[j]
            d = np.zeros((i - a0 + 2, j - b0 + 2))
            d[:, 0], d[0, :] = np.arange(i - a0 + 2), np.arange(j - b0 + 2)
            for x in range(a0, i + 1):
                for y in range(b0, j + 1):
                    p, q = x - a0 + 1, y - b0 + 1
                    both = min(d[p - 1, q] + 1, d[p, q - 1] + 1)
                    if s.left[x] == a0 and t.left[y] == b0:
                        d[p, q] = dist[x, y] = min(both, d[p - 1, q - 1] + _rename(s.labels[x], t.labels[y]))
                    else:
                        d[p, q] = min(both, d[s.left[x] - a0, t.left[y] - b0] + dist[x, y])
    return float(1 - dist[n - 1, m - 1] / max(n, m))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def table_similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similarities, "double")(a, b)
