"""Personal data: fixed patterns with checks, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) are found leftmost and non-overlapping per kind; matches that fail their check are
dropped without another try. The field adds what the patterns don't know: ``iban``, ``ssn``, ``tel`` (numbers without a
country prefix), ``name`` (behind a title or the like) and ``address`` (house number and street). Its chain are all words of
a text, ``[^\\x20\\x09-\\x0D]+`` without the punctuation around them; features are a word's shape (runs of digits, capitals
and other letters with their lengths, marks), the shape's ends, its digits and marks, whether it is one of the hint words
(``HINTS``), and the shapes and hints beside it. It learns from a small labelled table (``examples``, or any table of words
and B-/I-/O labels).

Texts are decoded by Viterbi in numpy batches, over all words, but exactly without visiting most of them: words whose
features are all plain have the same scores everywhere, and once ``Field.gap`` of them stand in a row, every best path has O
at a known one of them (found for the trained weights by going through all label pairs around such a run). The chain is
cut there into pieces that don't depend on each other. Spans of the field that overlap a pattern's are left out.

Defined results: null text is empty; positions are code points, ends exclusive; spans are ordered by kind (as listed
above), then start.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, riding, row_steps, splitmix, string_parts, table, unpacked
from .textvec import NON_SPACE, Words, find_words, mix, word_hashes

BASE = ("email", "ip", "card", "phone")
LEARNED = ("iban", "ssn", "tel", "name", "address")
#: words that may stand beside personal data
HINTS = "call phone telephone tel fax mobile cell ssn social security iban account bank mr mrs ms miss dr prof name signed street road avenue ave lane square address".split()
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and anchored at the start of a run of digits: the same matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def patterns(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) < 256 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


_EDGE = ".,;:!?\"'#*$%&|<>[]{}"
_DIGITS, _CAPITALS, _LETTERS = 0, 1, 2
_KIND = np.array([_LETTERS if x >= 0x80 or chr(x).islower() else _CAPITALS if chr(x).isupper() else _DIGITS if chr(x).isdigit() else 3 + x for x in range(256)], np.int64)
_LONGEST = np.array([12, 3, 3] + [1] * 256)
_PLAIN_BYTE = _KIND == _LETTERS
_CORE = NON_SPACE & ~np.isin(np.arange(256), [ord(x) for x in _EDGE])
_MARK = np.array([0 if k < 3 else 1 << (k * 7 % 61) for k in _KIND.tolist()], np.uint64)
_PLAIN, _NONE = np.uint64(splitmix(101)), np.uint64(splitmix(102))
_SALTS = np.array([splitmix(200 + k) for k in range(13)], np.uint64)
_POWER = np.uint64(0x9FB21C651E98DF25)


def _hint_hashes() -> np.ndarray:
    data, offsets = string_parts(pa.array([" ".join(HINTS)]))
    return np.sort(word_hashes(find_words(data, offsets, NON_SPACE), lower=True))


class Looks:
    """What the features of words are made of: trimmed bounds and, by word, hashes of shape, its first and last three runs, digits, marks and hint."""

    def __init__(self, w: Words):
        n = len(w)
        lo, hi = (int(w.start[0]), int(w.end[-1])) if n else (0, 0)
        core = np.flatnonzero(_CORE[w.data[lo:hi]]) + lo
        core = np.append(core, np.iinfo(np.int64).max)
        begin = core[np.searchsorted(core, w.start)]
        some = begin < w.end
        end = core[np.maximum(np.searchsorted(core, w.end) - 1, 0)] + 1
        self.start, self.end = np.where(some, begin, w.start), np.where(some, end, w.start)
        self.first, self.count = w.first, w.count
        odd = np.zeros(hi - lo + 1, np.int32)
        np.cumsum(~_PLAIN_BYTE[w.data[lo:hi]], out=odd[1:])
        self.plain = odd[self.end - lo] == odd[self.start - lo]
        h = word_hashes(Words(w.data, self.start, self.end, w.count, w.first), lower=True)
        known = _hint_hashes()
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        self.hint = np.where(known[at] == h, h, _PLAIN)
        self.shape, self.head, self.tail, self.digits, self.marks = (np.full(n, _PLAIN) for _ in range(5))
        sel = np.flatnonzero(~self.plain)
        if len(sel):
            self._shapes(w.data, sel)

    def _shapes(self, data: np.ndarray, sel: np.ndarray) -> None:
        size = (self.end - self.start)[sel]
        stop = np.cumsum(size)
        at = stop - size
        flat = data[np.arange(stop[-1]) + np.repeat(self.start[sel] - at, size)]
        kind = _KIND[flat]
        new = np.ones(len(flat), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > _LETTERS)
        new[at] = True
        runs = np.flatnonzero(new)
        what = kind[runs]
        code = mix((what * 16 + np.minimum(np.diff(np.append(runs, len(flat))), _LONGEST[what])).astype(np.uint64) + np.uint64(1))
        first = np.searchsorted(runs, at)
        many = np.diff(np.append(first, len(runs)))
        place = np.arange(len(runs)) - np.repeat(first, many)
        back = np.repeat(many, many) - 1 - place
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(many.max()), _POWER)]))
        self.shape[sel] = np.add.reduceat(code * power[place], first)
        self.head[sel] = np.add.reduceat(np.where(place < 3, code * power[place], np.uint64(0)), first)
        self.tail[sel] = np.add.reduceat(np.where(back < 3, code * power[np.minimum(back, 3)], np.uint64(0)), first)
        self.digits[sel] = np.minimum(np.add.reduceat((kind == _DIGITS).astype(np.int64), at), 20).astype(np.uint64)
        self.marks[sel] = np.bitwise_or.reduceat(_MARK[flat], at)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """(n, 13) feature keys of the words ``at``."""
        last = np.zeros(len(self.plain) + 1, bool)
        last[self.first] = True  # a word before which a document begins; the end
        lone_left, lone_right = last[at], last[at + 1]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 1, len(self.plain) - 1)
        cols = [np.full(len(at), _PLAIN), self.shape[at], self.head[at], self.tail[at], self.digits[at], self.marks[at], self.hint[at]]
        cols += [np.where(lone_left, _NONE, x[left]) for x in (self.shape, self.head, self.hint)]
        cols += [np.where(lone_right, _NONE, x[right]) for x in (self.shape, self.head, self.hint)]
        return mix(np.stack(cols, axis=1) * np.uint64(0x9E3779B97F4A7C15) + _SALTS)


def examples(n: int = 1500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The default labelled table: invented sentences with numbers, names and addresses of each kind and, as O, what is none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    low = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwéüñ") for _ in range(rng.randint(1, 9)))
    cap = lambda: low().capitalize()
    some = lambda *x: rng.choice(x)
    hinted = lambda *x: [some(*x)] if rng.random() < 0.5 else []
    rows = []
    for _ in range(n):
        kind = some("tel", "ssn", "iban", "name", "address", "O", "O", "O", "O", "O")
        before: list[str] = []
        if kind == "tel":
            before = hinted("call", "tel:", "phone", "Phone:", "fax", "mobile")
            words = some(lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [f"({d(3)}){d(3)}-{d(4)}"])()
        elif kind == "ssn":
            before = hinted("ssn", "SSN", "security", "ssn:")
            words = [f"{d(3)}-{d(2)}-{d(4)}"]
        elif kind == "iban":
            before = hinted("iban", "IBAN", "account", "IBAN:")
            land = some("DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT")
            words = [land + d(2), *[d(4) for _ in range(rng.randint(3, 5))], d(2)] if rng.random() < 0.5 else [land + d(20)]
        elif kind == "name":
            before = [some("Mr.", "Mrs.", "Ms", "Dr.", "Prof.", "dr", "mr", "name:", "Name:", "signed", "Miss")]
            words = [cap() + "x" for _ in range(rng.randint(1, 2))]
        elif kind == "address":
            words = [d(rng.randint(1, 4)), *[cap() + "x" for _ in range(rng.randint(1, 2))], some("Street", "Road", "Avenue", "Ave", "Lane", "Square")]
        else:
            words = some(
                lambda: [d(rng.randint(1, 6))], lambda: [f"{d(1)}.{d(1)}."], lambda: [f"{d(2)}.{d(3)}"], lambda: [f"{d(2)},{d(3)}"], lambda: [f"20{d(2)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}/{d(2)}/19{d(2)}"],
                lambda: [d(16)], lambda: [".".join(d(rng.randint(1, 3)) for _ in range(4))], lambda: [hexa(some(8, 24, 32, 40))], lambda: ["AKIA" + hexa(16).upper()], lambda: [f"word.{d(2)}@mail{d(1)}.example.com"],
                lambda: [f"v{d(1)}.{d(2)}.{d(1)}"], lambda: [f"{d(3)}-{d(4)}"], lambda: [f"{d(4)}-{d(4)}"], lambda: [f"({d(3)})"], lambda: [f"({d(4)})"], lambda: [f"+{d(1)}"], lambda: [f"{d(2)}:{d(2)}"], lambda: [f"${d(3)}"], lambda: [f"{d(2)}%"],
                lambda: [d(rng.randint(7, 15))], lambda: [d(4), d(4), d(4), d(4)], lambda: [f"ab{d(3)}c{d(2)}"], lambda: [f"A{d(2)}"], lambda: [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: ["token", "=", f'"{hexa(40)}"'],
                lambda: [cap()], lambda: [cap(), cap()], lambda: [cap().upper()], lambda: [cap().upper() + "!!", cap().upper()], lambda: [d(2), cap()], lambda: [cap(), d(3)], lambda: [some("the", "of"), some("street", "name", "call", "square", "lane")], lambda: [f"{low()}-{low()}"],
                lambda: [cap() + "***", cap()], lambda: [f"{low()}'{low()}"], lambda: [f"{low()}({low()})"], lambda: [some("Street", "Road", "Name", "Call", "Bank")], lambda: [some("dr", "mr", "name", "signed"), low()], lambda: [cap(), some("street", "road", "Street")], lambda: [f"{low()}.{cap()}"], lambda: ["—"],
                *[lambda: [cap() + some("", ".", ",")] * rng.randint(2, 9), lambda: [cap() + some("", ".", ",", "!!") for _ in range(rng.randint(2, 7))], lambda: [cap().upper() + some("", "!!", ",!!") for _ in range(rng.randint(2, 7))], lambda: [d(2), *[cap() for _ in range(rng.randint(1, 3))]]] * 4,
            )()
        tags = ["O"] * len(words) if kind == "O" else [f"B-{kind}"] + [f"I-{kind}"] * (len(words) - 1)
        number = lambda: [d(rng.randint(1, 4))] if rng.random() < 0.1 else []
        lead, tail = [*[low() for _ in range(rng.randint(0, 3))], *number(), *before], [*number(), *[some(low, low, cap)() for _ in range(rng.randint(0, 3))]]
        if lead and rng.random() < 0.3:
            lead[0] = lead[0].capitalize()
        if rng.random() < 0.3:
            words[-1] += some(".", ",", ";", "!!", "***", "&&&")
        part = ([*lead, *words, *tail], ["O"] * len(lead) + tags + ["O"] * len(tail))
        if rows and len(rows[-1][0]) < 24:  # sentences follow each other
            rows[-1] = (rows[-1][0] + part[0], rows[-1][1] + part[1])
        else:
            rows.append(part)
    for _ in range(n // 40):  # long runs of capitals
        again, many = cap(), rng.randint(20, 40)
        words = [again] * many if rng.random() < 0.5 else [some(cap, cap, low)() for _ in range(many)]
        rows.append((words, ["O"] * many))
    return rows


class Field:
    """Weights and decoding. I- only behind B- or I- of its kind."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], rounds: int = 60):
        rows = [r for r in rows if r[0]]
        self.labels = sorted({x for _, tags in rows for x in tags} | {"O"})
        k = len(self.labels)
        at = {x: i for i, x in enumerate(self.labels)}
        self.o = at["O"]
        allowed = np.array([[b[0] != "I" or a[1:] == b[1:] for b in self.labels] for a in self.labels])
        begin = np.array([x[0] != "I" for x in self.labels])
        data, offsets = string_parts(pa.array([" ".join(words) for words, _ in rows], pa.large_string()))
        w = find_words(data, offsets, NON_SPACE)
        self.known, ids = np.unique(Looks(w).keys(np.arange(len(w))), return_inverse=True)
        ids = ids.reshape(len(w), len(_SALTS))
        weights, trans = np.zeros((len(self.known), k)), np.zeros((k, k))
        n, t = len(rows), int(w.count.max()) if rows else 1
        size = w.count
        row, pos = w.doc(), np.arange(len(w)) - np.repeat(w.first[:-1], size)
        live = np.arange(t)[None] < size[:, None]
        gold = np.zeros((n, t, k))
        gold[row, pos, [at[x] for _, tags in rows for x in tags]] = 1
        real = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:] * live[:, 1:, None])
        gw, gt = np.full_like(weights, 1e-8), np.full((k, k), 1e-8)
        for _ in range(rounds if n else 0):
            e = np.zeros((n, t, k))
            e[row, pos] = weights[ids].sum(axis=1)
            p = np.exp(e - e.max(axis=2, keepdims=True))
            a = np.exp(trans) * allowed
            alpha, beta = np.zeros((n, t, k)), np.ones((n, t, k))
            v = p[:, 0] * begin
            alpha[:, 0] = v / v.sum(axis=1, keepdims=True)
            for i in range(1, t):
                v = (alpha[:, i - 1] @ a) * p[:, i] + 1e-300
                alpha[:, i] = v / v.sum(axis=1, keepdims=True)
            for i in range(t - 2, -1, -1):
                v = (p[:, i + 1] * beta[:, i + 1]) @ a.T
                beta[:, i] = np.where(live[:, i + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            both = alpha[:, :-1, :, None] * a * (p[:, 1:] * beta[:, 1:])[:, :, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            miss = (post - gold)[row, pos]
            g = np.stack([np.bincount(ids.ravel(), np.repeat(miss[:, c], ids.shape[1]), len(self.known)) for c in range(k)], axis=1) + 0.05 * weights
            h = (both * live[:, 1:, None, None]).sum(axis=(0, 1)) - real + 0.05 * trans
            for value, grad, seen in ((weights, g, gw), (trans, h, gt)):
                seen += grad * grad
                value -= 0.5 * grad / np.sqrt(seen)
        self.weights = np.vstack([weights, np.zeros(k)])  # the last row: unknown features
        self.trans, self.begin = np.where(allowed, trans, -1e30), np.where(begin, 0.0, -1e30)
        self.gap = self._gap()

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """(n, labels) from (n, features) keys."""
        out = np.zeros((len(keys), self.weights.shape[1]))
        for col in keys.T if len(self.known) else ():
            at = np.minimum(np.searchsorted(self.known, col), len(self.known) - 1)
            out += self.weights[np.where(self.known[at] == col, at, len(self.known))]
        return out

    def _gap(self, longest: int = 64) -> int:
        """The least number of plain words in a row of which the middle one has O on every best path, whatever is around them; 0 if none is found."""
        data, offsets = string_parts(pa.array(["a b c"]))
        e = self.scores(Looks(find_words(data, offsets, NON_SPACE)).keys(np.array([1])))[0]
        k = len(e)
        ahead = np.where(np.eye(k, dtype=bool), 0.0, -1e30)  # best score from a label through some plain words to a label
        reach = [ahead]
        for _ in range(longest):
            ahead = (ahead[:, :, None] + (self.trans + e[None])[None]).max(axis=1)
            reach.append(ahead)
        for n in range(1, longest):
            left, right = reach[n // 2 + 1], reach[n - 1 - n // 2]
            tail = (right[:, :, None] + self.trans[None]).max(axis=1)  # and on to the label behind them
            total = left[:, :, None] + tail[None]
            best = np.delete(total, self.o, axis=1).max(axis=1) if k > 1 else np.full((k, k), -np.inf)
            if ((total[:, self.o] > best + 1e-9) | (total[:, self.o] < -1e29)).all():
                return n
        return 0

    def pieces(self, looks: Looks) -> list[tuple[int, int, bool, bool]]:
        """(first word, end, first is known to be O, last is known to be O) of the parts of chains to be decoded, every word that is not plain among them."""
        n = len(looks.plain)
        on = ~looks.plain | (looks.hint != _PLAIN)
        on[1:] |= on[:-1]
        on[:-1] |= on[1:].copy()
        full = np.flatnonzero(looks.count)
        lo, hi = looks.first[full], looks.first[full + 1] - 1
        if self.gap:
            on[lo] = on[hi] = True
        else:
            on[:] = True
        at = np.flatnonzero(on)
        if not len(at):
            return []
        doc = np.searchsorted(lo, at, "right")
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (np.diff(at) > self.gap) & bool(self.gap)) + 1
        s, e = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
        d = np.searchsorted(lo, s, "right") - 1
        before, behind = s > lo[d], e < hi[d]
        mid = self.gap // 2
        s, e = np.where(before, s - self.gap + mid, s), np.where(behind, e + 1 + mid, e)
        return list(zip(s.tolist(), (e + 1).tolist(), before.tolist(), behind.tolist(), strict=True))

    def decode(self, looks: Looks, cells: int = 100_000) -> np.ndarray:
        """Best label of every word (Viterbi), by pieces in batches of like length."""
        tags = np.full(len(looks.plain), self.o)
        pieces = sorted(self.pieces(looks), key=lambda x: x[1] - x[0])
        k, a = len(self.labels), 0
        only = np.where(np.arange(k) == self.o, 0.0, -1e30)
        while a < len(pieces):
            b = a + 1
            while b < len(pieces) and (b + 1 - a) * (pieces[b][1] - pieces[b][0]) <= cells:
                b += 1
            start, end, before, behind = (np.array(x) for x in zip(*pieces[a:b], strict=True))
            size = end - start
            m, t = len(size), int(size[-1])
            row = np.repeat(np.arange(m), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            e = np.zeros((t, m, k))
            e[pos, row] = self.scores(looks.keys(start[row] + pos))
            best = e[0] + np.where(before[:, None], only, self.begin)
            back = np.zeros((t, m, k), np.int8)
            for i in range(1, t):
                score = best[:, :, None] + self.trans[None]
                back[i] = score.argmax(axis=1)
                best = np.where((i < size)[:, None], score.max(axis=1) + e[i], best)
            tag = np.where(behind, self.o, best.argmax(axis=1))
            path = np.zeros((t, m), np.int64)
            for i in range(t - 1, -1, -1):
                path[i] = tag
                tag = np.where((i < size) & (i > 0), back[i, np.arange(m), tag], tag)
            tags[start[row] + pos] = path[pos, row]
            a = b
        return tags


@functools.cache
def default_field() -> Field:
    return Field(examples())


def find(texts: list[str | None], data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, ordered; ``data`` and ``offsets``: the same texts as bytes."""
    found = [patterns(t) if t else [] for t in texts]
    w = find_words(data, offsets, NON_SPACE)
    looks = Looks(w)
    tags = field.decode(looks)
    names = field.labels
    opens = np.array([x[0] == "B" for x in names])
    last, taken = -1, None
    for i in np.flatnonzero(opens[tags]).tolist():
        kind, j = names[tags[i]][2:], i + 1
        d = int(np.searchsorted(w.first, i, "right")) - 1
        while j < w.first[d + 1] and names[tags[j]] == f"I-{kind}":
            j += 1
        if d != last:
            last = d
            chars = np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)
            taken = sorted((x, y) for _, x, y in found[d])
            starts, tops = [x for x, _ in taken], np.maximum.accumulate([y for _, y in taken]).tolist() if taken else []
        a, b = int(chars[looks.start[i] - offsets[d]]) - 1, int(chars[looks.end[j - 1] - 1 - offsets[d]])
        k = bisect_left(starts, b)
        if not k or tops[k - 1] <= a:
            found[d].append((kind, a, b))
    rank = {kind: k for k, kind in enumerate(BASE + LEARNED)}
    return [sorted(f, key=lambda x: (rank.get(x[0], 99), x)) for f in found]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, last = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            parts += [text[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join([*parts, text[last:]])


_ADDED = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]


def scan(docs: DataFrame, *, text_col: str = "text", rows: list[tuple[list[str], list[str]]] | None = None, redact: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans (replacing columns of these names) and, if asked, ``redacted`` text. ``rows``: the labelled table."""
    known = docs.sparkSession.sparkContext.broadcast(default_field() if rows is None else Field(rows))

    def make():
        def step(text):
            data, offsets = string_parts(text)
            texts = text.to_pylist()
            out: list[list] = [[] for _ in range(len(_ADDED) + redact)]
            for i, j in row_steps(offsets):
                for t, spans in zip(texts[i:j], find(texts[i:j], data, offsets[i : j + 1], known.value), strict=True):
                    base = [x for x in spans if x[0] in BASE]
                    row = [sum(x[0] == k for x in base) for k in BASE] + [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)] + [redacted(t or "", spans)] * redact
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
            return [pa.array(x, pa.int64() if k < len(BASE) else pa.string()) for k, x in enumerate(out)]

        return step

    return append_columns(docs, [text_col], make, T.StructType(_ADDED + [T.StructField("redacted", T.StringType())] * redact))


def redact(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null, other columns as they are."""
    seen = scan(riding(docs, text_col), text_col="text", redact=True, **how)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return seen.select(*unpacked(docs, text_col, text))


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
