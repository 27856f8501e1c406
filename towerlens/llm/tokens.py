"""Token ids of whole texts, computed once per distinct part of a text.

In a byte-level BPE whose pre-tokenizer never joins a non-space character with the space behind
it, a text may be cut before every single space that stands between two non-space characters,
and the ids of the pieces, put together, are the ids of the text. The pre-tokenizer of GPT-2 always
cuts between a letter or digit and an ASCII sign other than the apostrophe, and around a line feed
between two non-space characters, too. So the bytes of each batch are cut there by numpy (at spaces
only for another pre-tokenizer), and the tokenizer sees every distinct part of a worker once. Texts for which the cut is not safe (a space
next to other white space or at the end, or the name of a special token) are encoded whole.
"""

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from towerlens.llm.memory import kept, release

END_ID = 0
# Parts that one worker remembers; beyond that it starts anew. Results do not depend on it.
MAX_PARTS = 300_000
# Bytes of text that are handled at once, and of parts that are encoded in one call.
BLOCK_BYTES = 1 << 20
CALL_BYTES = 1000

_UNSAFE = (
    r" [\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]| $|<\|"
)

# Kinds of bytes: of ASCII letters and digits and the second byte of letters from U+00C0 to U+00FF,
# their first byte, ASCII signs without the apostrophe (it may begin "'s"), and the apostrophe.
_OTHER, _LETTER, _LEAD, _SIGN, _QUOTE, _SPACE, _FEED = range(7)


def _kinds():
    kinds = np.full(256, _OTHER, np.uint8)
    for code in range(0x21, 0x7F):
        kinds[code] = _LETTER if chr(code).isalnum() else _SIGN
    kinds[ord("'")], kinds[ord(" ")], kinds[ord("\n")] = _QUOTE, _SPACE, _FEED
    return kinds


def _cut_table():
    """Whether a text may be cut between a byte of one kind and one of another, at (first * 8 + second)."""
    table = np.zeros((8, 8), bool)
    table[:, _SPACE] = True
    table[[_LETTER, _SIGN, _QUOTE], _FEED] = True
    table[_LETTER, _SIGN] = table[_SIGN, _LETTER] = table[_SIGN, _LEAD] = True
    return table.ravel()


_KINDS, _CUTS = _kinds(), _cut_table()


def part_starts(data, offsets, fine=True):
    """Where parts begin in the bytes ``data`` of texts; ``offsets`` are those of the texts. Parts
    begin at spaces only if they are not to be ``fine``."""
    if not fine:
        return np.union1d(np.flatnonzero(data == 0x20), offsets[offsets < len(data)])
    kinds = _KINDS[data]
    second = 1 + np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kinds[second], kinds[second - 1] = _LETTER, _LEAD
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    # Of several line feeds the last is cut off by what is behind it, so they stay with that.
    single = np.flatnonzero(cut[:-2] & (kinds[:-1] == _FEED))
    follows = kinds[single + 1]
    cut[1 + single[(follows != _OTHER) & (follows < _SPACE)]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class WordTokenizer:
    """Encodes Arrow string arrays with one tokenizer file."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        cutter = self.tokenizer.pre_tokenizer
        self.fine = self.tokenizer.normalizer is None and isinstance(cutter, ByteLevel) and cutter.use_regex
        size = self.tokenizer.get_vocab_size()
        self.token_bytes = np.array(
            [len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64
        )
        self._forget()

    def _forget(self):
        self.known = {}
        self.ids = np.array([END_ID], np.int32)
        self.starts = np.array([0], np.int64)
        self.lengths = np.array([1], np.int64)
        self.seen = np.array([0], np.int32)
        self.free, self.used = 1, 1

    def _thin(self):
        """Keep the parts that more than one block held, if they leave enough room."""
        old = np.fromiter(self.known.values(), np.int64, len(self.known))
        again = self.seen[old] > 1
        parts, old = list(itertools.compress(self.known, again)), old[again]
        ids, starts, lengths = self.ids, self.starts, self.lengths
        self._forget()
        if 0 < len(parts) < MAX_PARTS // 2:
            first = self._append(gathered(ids, starts[old], lengths[old]), lengths[old])
            self.known.update(zip(parts, range(first, first + len(parts))))
            self.seen[first : first + len(parts)] = 1

    def _append(self, ids, lengths):
        """Store ids of new entries; return the number of the first of them."""
        first, n, m = self.used, len(lengths), len(ids)
        while self.used + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        while self.free + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.free : self.free + m] = ids
        self.starts[first : first + n] = self.free + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.seen[first : first + n] = 0
        self.free += m
        self.used += n
        return first

    def _encode_each(self, texts):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int32), lengths

    def _encode_spaced(self, parts):
        """Parts that begin with a space, joined into longer calls and cut again by their bytes."""
        sizes = np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts))
        calls = ["".join(parts[i:j]) for i, j in row_blocks(sizes, CALL_BYTES)]
        got = self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.array(list(itertools.chain.from_iterable(e.ids for e in got)), np.int32)
        ends = np.cumsum(sizes)
        reached = np.cumsum(self.token_bytes[ids])
        cut = np.searchsorted(reached, ends) + 1
        if cut[-1] != len(ids) or not np.array_equal(reached[cut - 1], ends):
            return self._encode_each(parts)
        return ids, np.diff(cut, prepend=0)

    def _entries(self, parts):
        """The entry number of every one of the distinct parts; unknown ones are encoded first."""
        numbers = np.fromiter(map(self.known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = parts[unknown]
            spaced = np.fromiter((p[0] == " " for p in new), bool, len(new))
            for chosen, encode in ((spaced, self._encode_spaced), (~spaced, self._encode_each)):
                if chosen.any():
                    these = new[chosen].tolist()
                    first = self._append(*encode(these))
                    found = range(first, first + len(these))
                    self.known.update(zip(these, found))
                    numbers[unknown[chosen]] = found
        self.seen[numbers] += 1
        return numbers

    def _block(self, texts):
        """(ids with END_ID behind every text, number of ids per text) of one block."""
        if len(self.known) > MAX_PARTS:
            self._thin()
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        if len(whole):
            cuttable = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        else:
            cuttable = texts
        _, offsets, data = cuttable.buffers()
        offsets = np.frombuffer(offsets, np.int64)[cuttable.offset : cuttable.offset + len(texts) + 1]
        offsets, first = offsets - offsets[0], int(offsets[0])
        size = int(offsets[-1])
        if size:
            data = data.slice(first, size)
            starts = part_starts(np.frombuffer(data, np.uint8), offsets, self.fine)
            bounds = pa.py_buffer(np.append(starts, size))
            parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, data])
            coded = parts.dictionary_encode()
            numbers = self._entries(coded.dictionary.to_numpy(zero_copy_only=False))
            numbers = numbers[coded.indices.to_numpy()]
        else:
            starts = numbers = np.zeros(0, np.int64)
        ends = np.searchsorted(starts, offsets[1:])
        if len(whole):
            ids, lengths = self._encode_each(texts.take(pa.array(whole)).to_pylist())
            first = self._append(ids, lengths)
            numbers = np.insert(numbers, ends[whole], np.arange(first, first + len(whole)))
            ends = ends + np.cumsum(odd)
        numbers = np.insert(numbers, ends, 0)  # entry 0 is END_ID
        lengths = self.lengths[numbers]
        bounds = np.cumsum(lengths)[ends + np.arange(len(texts))]
        return gathered(self.ids, self.starts[numbers], lengths), np.diff(bounds, prepend=0)

    def blocks(self, texts):
        """Yield (first row, ids, ids per text) over an Arrow array; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        for n, (start, stop) in enumerate(row_blocks(sizes, BLOCK_BYTES)):
            ids, lengths = self._block(texts.slice(start, stop - start))
            yield start, ids, lengths
            del ids, lengths
            if n % 8 == 7:  # giving memory back takes time too
                release()
        release()


def gathered(ids, starts, lengths):
    """The runs of ``ids`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(lengths)
    # Four bytes a number do for all but texts of billions of ids.
    kind = np.int32 if not len(ends) or max(ends[-1], len(ids)) < 1 << 31 else np.int64
    source = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    source += np.arange(len(source), dtype=kind)
    return ids[source]


def row_blocks(sizes, most):
    """Consecutive row ranges of about ``most`` bytes; a larger row stands alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def tokenizer_for(path):
    """The worker's tokenizer of this file; it is kept between the tasks of a worker."""
    return kept("tokenizer", path, lambda: WordTokenizer(path))
