"""Memory that a block of text takes while it is encoded, as many workers do that side by side."""

import tracemalloc

import public_tokenizers
import pyarrow as pa

from towerlens.llm import tokens


def test_arrays_of_a_block_stay_small():
    words = [f"word{i % 700}" for i in range(4000)]
    texts = pa.array([" ".join(words[i % 97 :]) for i in range(300)])
    encoder = tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in encoder.blocks(texts):  # parts are known from here on
        pass
    tracemalloc.start()
    n = 0
    for _, ids, lengths in encoder.blocks(texts):
        assert lengths.sum() == len(ids)
        n += len(lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts)
    assert peak < 16 << 20, peak
