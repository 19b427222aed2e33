import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import text as words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\ré  Z", max_size=40)), max_size=8)


def plain(t, lower=False):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


@settings(max_examples=200, deadline=None)
@given(TEXT, st.booleans())
def test_words_are_those_of_the_rule(texts, lower):
    for low, high, data, at in words.chunks(pa.array(texts, pa.string()), 16):
        w = words.Words(data, at, lower)
        want = [plain(t, lower) for t in texts[low:high]]
        got = [[w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == want
        by = {}
        for x, h in zip([x for row in want for x in row], w.hashes().tolist(), strict=True):
            assert by.setdefault(x, h) == h
        assert len(set(by.values())) == len(by)


def test_grams_and_spans_tell_sequences_apart():
    h = words.mix(np.random.default_rng(0).integers(0, 50, 3000).astype(np.uint64))
    spans = words.Spans(h)
    for n in (1, 2, 3, 5, 12, 50):
        for got in (words.grams(h, n), spans.hash(np.arange(len(h) - n + 1), np.arange(n, len(h) + 1))):
            by = {}
            for i, g in enumerate(got.tolist()):
                assert by.setdefault(tuple(h[i : i + n].tolist()), g) == g
            assert len(set(by.values())) == len(by)


def test_sliding():
    x = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for n in (1, 2, 7, 39, 200, 201):
        assert words.sliding(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]
