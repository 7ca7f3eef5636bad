import random

import numpy as np
import pyarrow as pa

from pressroom.llm.common import byte_table, flat_bytes, shingles_of, text_slices, words_of
from tests.llm.plain import shingles


def test_shingle_hashes_are_one_to_one_with_shingles():
    rng = random.Random(4)
    texts = [None, "", " \n", "A b", "a B"] + ["".join(rng.choice(["ab", "AB", "c", " ", "  ", "\n", "\u2003", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = shingles_of(*words_of(*flat_bytes(pa.array(texts)), byte_table(1)))
    names = {}
    for text, hashes in zip(texts, found, strict=True):
        want = shingles(text)
        assert len(hashes) == len(want) and (np.diff(hashes.astype(float)) >= 0).all()
        names.setdefault(want, set()).add(hashes.tobytes())
    assert all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names)


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 50, 1, 0, 200, 3)]})
    parts = list(text_slices(batch, "text", 20))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert len(parts) > 2
    assert not list(text_slices(batch.slice(0, 0), "text"))
