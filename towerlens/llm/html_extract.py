"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks of text (``html_blocks``). Each block is read as three
vectors: hashed names of the elements above it, hashed words of its whole text, and a few measures
such as its length and the share of its text in links. A bidirectional LSTM in numpy runs over the
whole sequence, so every block is judged with all that stands before and behind it, and gives each
block the probability that it belongs to the article. Those blocks, joined by a space, are the text.

The model is trained on ``TRAIN_PAGES`` pages of ``page_maker`` at most, made by a fixed rule; no page of the table is learnt from. It has some 100 KB and travels with the tasks.

Defined cases: a null html is empty and gives an empty text, and so does a page without a block of
the article; repeated rows give repeated rows; an open or wrong tag ends at the end of its page;
other columns are not used. Pages are read whole. Blocks of a long page are read in pieces of
``STEP_BLOCKS``, of which only the states between them are kept; nothing is cut off.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens.llm import html_blocks
from towerlens.llm.memory import release
from towerlens.llm.page_maker import Maker
from towerlens.llm.words import BLOCK_BYTES, text_blocks, word_bounds, word_hashes

TRAIN_PAGES = 2000
EPOCHS = 7
BATCH_PAGES = 24
HIDDEN = 24
INPUT = 24
PATH_BUCKETS = 512
WORD_BUCKETS = 128
MEASURES = 14
STEP_BLOCKS = 4096
# Blocks that are padded together.
PADDED_BLOCKS = 1 << 14
EXTRACTED = "page_id long, url string, text string, n_chars long"


def _bucket(name):
    value = 1
    for byte in name.encode():
        value = (value * 257 + byte) % 2_147_483_647
    return value % PATH_BUCKETS


def path_buckets(path):
    """Buckets of the names above a block: elements, the two next ones by place, words of classes
    and their beginnings."""
    names = set()
    for tag, words in path:
        names.add(f"e {tag}")
        for word in words:
            names.update((f"n {word}", f"b {word[:4]}"))
    for place, (tag, words) in enumerate(reversed(path[-2:])):
        names.add(f"{place} {tag}")
        names.update(f"{place} {word}" for word in words)
    names.add("> " + " ".join(tag for tag, _ in path[-2:]))
    return sorted({_bucket(n) for n in names})


def word_vectors(texts):
    """Shares of a text's words in each bucket, over whole texts."""
    out = np.zeros((len(texts), WORD_BUCKETS), np.float32)
    for first, data, offsets in text_blocks(pa.array(texts, pa.large_string())):
        starts, ends, counts = word_bounds(data, offsets)
        bucket = (word_hashes(data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        table = np.bincount(row * WORD_BUCKETS + bucket, minlength=len(counts) * WORD_BUCKETS)
        table = table.reshape(len(counts), WORD_BUCKETS)
        out[first : first + len(counts)] = table / np.maximum(counts, 1)[:, None]
    return out


def measures(found):
    """Length, links, signs and place of each block of one page."""
    out = np.zeros((len(found), MEASURES), np.float32)
    total = sum(len(b.text) for b in found) or 1
    seen = 0
    for i, block in enumerate(found):
        text = block.text
        n = len(text)
        words = text.count(" ") + 1
        stops = text.count(".") + text.count("!") + text.count("?")
        out[i] = (
            np.log1p(n) / 8, np.log1p(words) / 6, block.linked, stops / words,
            text.count(",") / words, text[-1] in ".!?:\"'»", n / words / 10, text[:1].isupper(),
            seen / total, i / len(found), n / total, block.path[-1][0][:1] == "h" and block.path[-1][0][1:].isdigit() if block.path else 0,
            i > 0 and found[i - 1].path == block.path, i + 1 < len(found) and found[i + 1].path == block.path,
        )
        seen += n
    return out


class Labeller:
    """The network: a tanh layer over the inputs, an LSTM in each direction, one output."""

    NAMES = ("path", "word", "measure", "bias", "in_f", "rec_f", "b_f", "in_b", "rec_b", "b_b", "out", "b_out")

    def __init__(self, seed=1):
        draw = np.random.default_rng(seed)

        def matrix(rows, columns, scale):
            return (draw.standard_normal((rows, columns)) * scale).astype(np.float32)

        self.path = matrix(PATH_BUCKETS, INPUT, 0.3)
        self.word = matrix(WORD_BUCKETS, INPUT, 0.3)
        self.measure = matrix(MEASURES, INPUT, 0.5)
        self.bias = np.zeros(INPUT, np.float32)
        for way in "fb":
            setattr(self, f"in_{way}", matrix(INPUT, 4 * HIDDEN, INPUT**-0.5))
            setattr(self, f"rec_{way}", matrix(HIDDEN, 4 * HIDDEN, HIDDEN**-0.5))
            start = np.zeros(4 * HIDDEN, np.float32)
            start[HIDDEN : 2 * HIDDEN] = 1  # gates that forget start open
            setattr(self, f"b_{way}", start)
        self.out = matrix(2 * HIDDEN, 1, HIDDEN**-0.5)
        self.b_out = np.zeros(1, np.float32)

    def read(self, path, word, measure):
        """Inputs of blocks from their summed path vectors, word shares and measures."""
        return np.tanh(path + word @ self.word + measure @ self.measure + self.bias)

    def run(self, way, x, mask, state, keep=None):
        """One direction over (time, pages, inputs); returns the hidden states and the last state."""
        h, c = state
        gates = x @ getattr(self, f"in_{way}") + getattr(self, f"b_{way}")
        rec, out = getattr(self, f"rec_{way}"), np.empty((*x.shape[:2], HIDDEN), np.float32)
        order = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            z = gates[t] + h @ rec
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            fresh = f * c + i * g
            tc = np.tanh(fresh)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            c = np.where(m, fresh, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, (h, c)

    def scores(self, x, mask):
        """Probabilities of (time, pages) blocks; long sequences in pieces of STEP_BLOCKS."""
        pages = x.shape[1]
        zero = (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        behind, state = np.empty((*x.shape[:2], 1), np.float32), zero
        cuts = list(range(0, len(x), STEP_BLOCKS))
        for at in reversed(cuts):
            part = slice(at, at + STEP_BLOCKS)
            hidden, state = self.run("b", x[part], mask[part], state)
            behind[part] = hidden @ self.out[HIDDEN:]
        state, out = zero, np.empty(x.shape[:2], np.float32)
        for at in cuts:
            part = slice(at, at + STEP_BLOCKS)
            hidden, state = self.run("f", x[part], mask[part], state)
            out[part] = (hidden @ self.out[:HIDDEN] + behind[part] + self.b_out)[..., 0]
        return 1 / (1 + np.exp(-out))


def _padded(pages, width):
    """(time, pages, width) array of pages of different lengths, and which places are filled."""
    longest = max(len(p) for p in pages)
    out = np.zeros((longest, len(pages), width), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for i, page in enumerate(pages):
        out[: len(page), i] = page
        mask[: len(page), i] = True
    return out, mask


def training_pages(count, seed):
    """(names, word shares, measures, labels) of made pages, by block."""
    maker, known, pages = Maker(seed), {}, []
    while len(pages) < count:
        page, labels = maker.page()
        found = html_blocks.blocks(page, known)
        if len(found) == len(labels) and found:
            pages.append((found, np.array(labels, np.float32)))
    cuts = np.cumsum([len(labels) for _, labels in pages])[:-1]
    words = np.split(word_vectors([b.text for found, _ in pages for b in found]), cuts)
    buckets = {b.path: path_buckets(b.path) for found, _ in pages for b in found}
    out = []
    for (found, labels), shares in zip(pages, words):
        names = np.zeros((len(found), PATH_BUCKETS), np.float32)
        for i, block in enumerate(found):
            names[i, buckets[block.path]] = 1
        out.append((names, shares, measures(found), labels))
    return out


_fitted = {}


def fit(pages=TRAIN_PAGES, epochs=EPOCHS, seed=1):
    """A labeller trained on made pages; the same at every call, so a process keeps the last one."""
    if (pages, epochs, seed) in _fitted:
        return _fitted[pages, epochs, seed]
    model, rows = Labeller(seed), training_pages(pages, seed)
    draw = np.random.default_rng(seed)
    first = {n: np.zeros_like(getattr(model, n)) for n in model.NAMES}
    second = {n: np.zeros_like(getattr(model, n)) for n in model.NAMES}
    step, steps = 0, epochs * -(-len(rows) // BATCH_PAGES)
    by_length = sorted(range(len(rows)), key=lambda i: len(rows[i][3]))
    batches = [by_length[i : i + BATCH_PAGES] for i in range(0, len(rows), BATCH_PAGES)]
    for _ in range(epochs):
        for b in draw.permutation(len(batches)):
            grads = _gradients(model, [rows[i] for i in batches[b]], draw)
            step += 1
            rate = 0.01 * (1 - step / (steps + 1))
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, grad in grads.items():
                grad = grad * min(1, 5 / (size + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                by = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                value = getattr(model, name)
                value -= (rate * by).astype(np.float32)
    _fitted.clear()
    _fitted[pages, epochs, seed] = model
    return model


def _gradients(model, pages, draw):
    """Gradients of the mean log loss over the blocks of some pages."""
    # Some names and words are hidden, so no single one decides.
    names, words, measured = (np.concatenate([p[i] for p in pages]) for i in range(3))
    names = names * (draw.random(names.shape, np.float32) > 0.15)
    words = words * (draw.random(words.shape, np.float32) > 0.2)
    read = model.read(names @ model.path, words, measured)
    cuts = np.cumsum([len(p[3]) for p in pages])[:-1]
    x, mask = _padded(np.split(read, cuts), INPUT)
    labels, _ = _padded([p[3][:, None] for p in pages], 1)
    zero = (np.zeros((len(pages), HIDDEN), np.float32),) * 2
    kept = {"f": [], "b": []}
    hidden = {way: model.run(way, x, mask, zero, kept[way])[0] for way in "fb"}
    both = np.concatenate([hidden["f"], hidden["b"]], 2)
    p = 1 / (1 + np.exp(-(both @ model.out + model.b_out)))
    error = (p - labels) * mask[..., None] / mask.sum()
    grads = {"out": np.tensordot(both, error, ((0, 1), (0, 1))), "b_out": error.sum((0, 1))}
    back = error @ model.out.T
    dx = np.zeros_like(x)
    for n, way in enumerate("fb"):
        dh_out = back[..., n * HIDDEN : (n + 1) * HIDDEN]
        rec = getattr(model, f"rec_{way}")
        drec, dz_all = np.zeros_like(rec), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = np.zeros((len(pages), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, tc in reversed(kept[way]):
            m = mask[t][:, None]
            total = dh + dh_out[t]
            do = total * tc
            dfresh = total * o * (1 - tc**2) + dc
            dz = np.concatenate(
                [dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), do * o * (1 - o), dfresh * i * (1 - g**2)], 1
            ) * m
            dz_all[t] = dz
            drec += h.T @ dz
            dh = np.where(m, dz @ rec.T, total)
            dc = np.where(m, dfresh * f, dc)
        grads[f"in_{way}"] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grads[f"rec_{way}"], grads[f"b_{way}"] = drec, dz_all.sum((0, 1))
        dx += dz_all @ getattr(model, f"in_{way}").T
    dread = np.concatenate([dx[: len(p[3]), i] for i, p in enumerate(pages)]) * (1 - read**2)
    grads.update(path=names.T @ dread, word=words.T @ dread, measure=measured.T @ dread, bias=dread.sum(0))
    return grads


class Reader:
    """Labels the blocks of many pages; one per task."""

    def __init__(self, model):
        self.model, self.paths, self.names = model, {}, {}

    def _path(self, path):
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= 1 << 14:
                self.paths.clear()
            found = self.paths[path] = self.model.path[path_buckets(path)].sum(0)
        return found

    def texts(self, pages):
        """The main text of each page."""
        blocks = [html_blocks.blocks(p, self.names) for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(blocks[order[stop]]) * (stop + 1 - at) <= PADDED_BLOCKS:
                stop += 1
            group = order[at:stop]
            flat = [b for i in group for b in blocks[i]]
            path = np.array([self._path(b.path) for b in flat])
            measured = np.concatenate([measures(blocks[i]) for i in group])
            read = self.model.read(path, word_vectors([b.text for b in flat]), measured)
            cuts = np.cumsum([len(blocks[i]) for i in group])[:-1]
            scores = self.model.scores(*_padded(np.split(read, cuts), INPUT))
            for n, i in enumerate(group):
                out[i] = " ".join(b.text for b, s in zip(blocks[i], scores[:, n]) if s >= 0.5)
            at = stop
        return out


def extracted(pages, model=None):
    """The main text of every page, in EXTRACTED."""
    model = fit() if model is None else model
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def run(batches):
        reader = Reader(model)
        for batch in batches:
            sizes = np.cumsum([len(h.as_buffer()) if h.is_valid else 0 for h in batch.column(2)])
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
                part = batch.slice(at, stop - at)
                texts = reader.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[c.split()[0] for c in EXTRACTED.split(", ")],
                )
                at = stop
            release()

    return rows.mapInArrow(run, EXTRACTED)
