import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import _words as w

TEXT = st.text(alphabet="ab Z\t\né日.!", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_a_split(texts):
    got = w.words_of(pa.array(texts, pa.string()), w.ASCII_SPACE, w.LOWER_AZ)
    data = got.data.tobytes()
    for r, t in enumerate(texts):
        own = [data[a:b].decode() for a, b in zip(got.start[got.first[r] : got.first[r + 1]], got.end[got.first[r] : got.first[r + 1]], strict=True)]
        assert own == [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    words = [data[a:b].lower() for a, b in zip(got.start, got.end, strict=True)]
    assert len({*words}) == len({*got.hash.tolist()}) and len({*zip(words, got.hash.tolist(), strict=True)}) == len({*words})


def test_long_words_and_slices():
    texts = ["a" * 200 + "b", "b" + "a" * 200, "a" * 201, "x" * (w.SLICE_BYTES + 5) + " y"]
    got = w.words_of(pa.array(texts))
    assert len(got.hash) == 5 and len({*got.hash.tolist()}) == 5
    alone = np.concatenate([w.words_of(pa.array([t])).hash for t in texts])
    assert (alone == got.hash).all()
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"])
    assert sum(s.num_rows for s in w.slices(batch, "text")) == 6


def test_shingles_of_short_rows():
    got = w.words_of(pa.array(["a b c d e", "a b", "", None, "a b c d", "b a"]))
    h, row = w.shingles(got, 4)
    assert row.tolist() == [0, 0, 1, 4, 5] and h[0] == h[3] and len({*h.tolist()}) == 4
