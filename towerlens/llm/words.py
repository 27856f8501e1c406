"""Words and word shingles of Arrow string columns as numpy arrays.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed
and return. All of these are single bytes in UTF-8, so words are found on the bytes, and a word's
hash is a difference of two prefix sums: the polynomial sum of its bytes' random numbers, divided
by the power at its start, then mixed. The numbers follow from fixed rules, so hashes are the
same on every machine.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from towerlens.llm.memory import release

# Bytes of text that are handled at once; a longer text stands alone.
BLOCK_BYTES = 2 << 20
# Bytes of one prefix sum.
SPAN_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """Spread 64-bit numbers over all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base, count):
    out = np.full(count, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, SPAN_BYTES)
_INVERSE = _powers(pow(int(_BASE), -1, 1 << 64), SPAN_BYTES)


def text_blocks(texts, most=BLOCK_BYTES):
    """Yield (first row, byte array, offsets) over an Arrow string array; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = texts.slice(start, stop - start)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield start, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        start = stop
    release()


def word_bounds(data, offsets):
    """(starts, ends, words per text) of all words in a block."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~space
    after = np.ones(len(data), bool)
    after[1:] = space[:-1]
    after |= edge[:-1]
    before = np.ones(len(data), bool)
    before[:-1] = space[1:]
    before |= edge[1:]
    starts = np.flatnonzero(solid & after)
    ends = np.flatnonzero(solid & before) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _sums(seg):
    out = np.zeros(len(seg) + 1, np.uint64)
    np.cumsum(_BYTE[seg] * _POWER[: len(seg)], out=out[1:])
    return out


def word_hashes(data, starts, ends):
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = int(np.searchsorted(ends, first + SPAN_BYTES, side="right"))
        if stop <= at:  # one word longer than a span: chain the hashes of its spans
            value = np.zeros(1, np.uint64)
            for i in range(first, ends[at], SPAN_BYTES):
                value = mix(_sums(data[i : min(i + SPAN_BYTES, ends[at])])[-1:] + value * _BASE)
            out[at] = value[0]
            at += 1
            continue
        sums = _sums(data[first : ends[stop - 1]])
        s = starts[at:stop] - first
        e = ends[at:stop] - first
        length = (ends[at:stop] - starts[at:stop]).astype(np.uint64)
        out[at:stop] = mix((sums[e] - sums[s]) * _INVERSE[s] + length)
        at = stop
    return out


def shingles(hashes, counts, width=5):
    """(shingle hashes, shingles per text): every run of ``width`` words of a text.

    A text of fewer words, but at least one, has a single shingle of all its words.
    """
    if len(hashes) == 0:
        return hashes, np.zeros(len(counts), np.int64)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.cumsum(counts) - counts
    first = np.repeat(bounds - (np.cumsum(per) - per), per) + np.arange(per.sum())
    length = np.repeat(np.minimum(counts, width), per)
    out = length.astype(np.uint64)
    for k in range(width):
        use = length > k
        value = hashes[np.minimum(first + k, len(hashes) - 1)]
        out = np.where(use, (out + value) * _BASE ^ (out >> np.uint64(29)), out)
    return mix(out), per


def distinct_per_text(values, per):
    """(sorted distinct values of each text, how many per text)."""
    if len(values) == 0:
        return values, per
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.bincount(text[fresh], minlength=len(per))
