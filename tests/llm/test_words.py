"""Vectorised words and hashes against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folia.llm import textvec as V
from folia.llm.common import row_steps, string_parts

TEXT = st.text(alphabet=st.sampled_from(list("abAB12 \t\n\x0b.,é日ß\x1c")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8), st.integers(1, 30))
def test_words_and_grams(texts, step):
    data, offsets = string_parts(pa.array(texts, pa.string()))
    seen = []
    for i, j in row_steps(offsets, step):
        for table, pattern, lower in ((V.NON_SPACE, r"[^\x20\x09-\x0D]+", False), (V.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
            w = V.find_words(data, offsets[i : j + 1], table)
            h, g = V.word_hashes(w, lower), V.gram_hashes(V.word_hashes(w, lower), 3)
            ok = V.inside(w.first, w.count, len(w), 3)
            for k in range(i, j):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[k] or "") if lower else texts[k] or ""
                want = re.findall(pattern, low)
                a, b = int(w.first[k - i]), int(w.first[k - i + 1])
                assert [w.bytes(x, x + 1, lower).decode() for x in range(a, b)] == want
                seen += [(pattern, x, int(y)) for x, y in zip(want, h[a:b], strict=True)]
                assert [bool(x) for x in ok[a : max(a, b - 2)]] == [True] * max(0, b - a - 2) and not ok[max(a, b - 2) : b].any()
                seen += [(pattern, tuple(want[x : x + 3]), int(g[a + x])) for x in range(max(0, b - a - 2))]
    assert len({(p, x) for p, x, _ in seen}) == len({(p, x, h) for p, x, h in seen}) == len({(p, h) for p, x, h in seen if isinstance(x, str)}) + len({(p, h) for p, x, h in seen if not isinstance(x, str)})


def test_no_rows():
    data, offsets = string_parts(pa.array([], pa.string()))
    assert list(row_steps(offsets)) == [] and len(data) == 0 and np.array_equal(offsets, [0])
