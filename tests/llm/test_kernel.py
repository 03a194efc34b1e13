import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillgrain.llm import kernel

TEXT = st.one_of(st.none(), st.text(st.sampled_from(" \t\n\x0b\rabAB é漢🙂 \x85"), max_size=30))


def plain(text, lower):
    t = "".join(c.lower() if lower and "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_and_shingles_are_those_of_a_regular_expression(texts):
    for lower in (True, False):
        assert [kernel.word_list(t, lower) for t in texts] == [plain(t, lower) for t in texts]
        counts, first, shingled = [], {}, []
        for part in kernel.slices(pa.array(texts, pa.string())):
            words = kernel.Words(part, lower)
            counts += words.counts().tolist()
            h, bounds = kernel.distinct(*kernel.shingles(words, 3))
            shingled += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert counts == [len(plain(t, lower)) for t in texts]
        for t, hashes in zip(texts, shingled, strict=True):
            w = plain(t, lower)
            want = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
            assert len(want) == len(hashes)
            for s, h in zip([tuple(sorted(want))], [tuple(hashes.tolist())], strict=True):
                assert first.setdefault(s, h) == h


def test_slices_cover_all_rows_and_offsets():
    texts = ["a" * 700_000, None, "b c", "d" * 2_000_000, "", "e"]
    array = pa.array(["zzz", *texts], pa.string()).slice(1)
    parts = list(kernel.slices(array))
    assert [bytes(p.data[p.bounds[i] : p.bounds[i + 1]]).decode() for p in parts for i in range(len(p))] == [t or "" for t in texts]
    assert [p.first for p in parts] == np.cumsum([0, *[len(p) for p in parts]])[:-1].tolist()
    assert list(kernel.slices(pa.array([], pa.string()))) == []
