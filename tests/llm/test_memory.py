"""What hashing whole texts takes and leaves behind in a worker, which lives on from stage to stage."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veilspark.llm import minhash
from veilspark.llm import textbytes as tb


def test_hashing_leaves_little_behind_and_long_words_count_whole():
    """24 MB of texts, and a word of 3 MB: less than 70 MB at once, of which less than 8 MB stay."""
    texts = [f"{k} " + "some words of a longer text that goes on " * 600 for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in minhash._sketch(8)([batch]))
        _, most = tracemalloc.get_traced_memory()
        word = np.full(3_000_000, 120, np.uint8)
        word[-1] = 121
        data = np.concatenate([word, [32], word, [32], word[::-1]]).astype(np.uint8)
        starts, stops, _, _ = tb.words(data, np.array([0, len(data)]))
        a, b, c = tb.hashes(data, starts, stops)
        kept = sum(p.nbytes for p in tb._POWERS)
    finally:
        tracemalloc.stop()
    assert rows == 1000 and a == b != c
    assert kept < 8_000_000 and most < 70_000_000, (kept, most)
