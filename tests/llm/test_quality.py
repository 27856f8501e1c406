from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD_ROWS, no_docs, odd_docs
from towerlens.llm import quality, words


def plain_model(texts):
    """Interpolated modified Kneser-Ney over bytes, by the book."""
    top = Counter()
    for t in texts:
        data = b"\n" * 3 + t.encode()
        top.update(data[i : i + 4] for i in range(len(data) - 3))
    tables = {4: dict(top)}
    for n in (3, 2, 1):
        tables[n] = dict(Counter(g[1:] for g in tables[n + 1]))
    cuts = {}
    for n, table in tables.items():
        c = Counter(table.values())
        n1, n2, n3, n4 = (max(c[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        cuts[n] = [max(0, min(i + 1, d)) for i, d in enumerate(raw)]
    sums = {n: defaultdict(lambda: [0, 0]) for n in tables}
    for n, table in tables.items():
        for g, c in table.items():
            sums[n][g[:-1]][0] += c
            sums[n][g[:-1]][1] += cuts[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n, c = len(g), tables[len(g)].get(g, 0)
        total, freed = sums[n][g[:-1]]
        if not total:
            return p(g[1:])
        return (max(c - cuts[n][min(c, 3) - 1], 0) if c else 0) / total + freed / total * p(g[1:])

    return p


def test_scores_match_a_plain_model(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the end of it all"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folder = f"file://{tmp_path}/model"
    quality.write_model(docs, folder)
    p = plain_model(texts)
    unseen = spark.createDataFrame([(9, "the cog zat", "en")], docs.schema)
    for r in quality.scored(docs.unionAll(unseen), folder).collect():
        text = (texts + ["the cog zat"])[min(r.doc_id, 4)]
        data = b"\n" * 3 + text.encode()
        total = sum(log(p(data[i : i + 4])) for i in range(len(text)))
        assert r.score == pytest.approx(-total / len(text.split()), rel=1e-4)
    assert sum(p(b"the" + bytes([i])) for i in range(256)) == pytest.approx(1)


def test_every_gram_is_kept_and_an_unseen_one_finds_nothing(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(chr(33 + c) for c in rng.integers(0, 90, 4000)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folder = f"file://{tmp_path}/model"
    monkeypatch.setattr(quality, "PART_ROWS", 50_000)
    quality.write_model(docs, folder)
    seen = {(t, k, b[i - k : i]) for j, x in enumerate(texts) for t in [j % 2] for b in [b"\n" * 3 + x.encode()] for k in (1, 2, 3, 4) for i in range(max(k, 4), len(b) + 1)}
    lines = spark.read.parquet(f"{folder}/grams")
    assert lines.count() == len(seen)
    every = quality.Model(folder)
    monkeypatch.setattr(quality, "HELD_BYTES", 1_000_000)
    few = quality.Model(folder)
    assert len(few.parts["grams"]) > 4
    gram = rng.integers(0, 1 << 32, 200_000).astype(np.uint32)
    language = rng.integers(-1, 2, len(gram))
    known = np.array([(t, 4, int(g).to_bytes(4, "big")) in seen for t, g in zip(language, gram)])
    keys = quality.keys(gram.astype(np.int64), 4, language)
    assert (every._find("grams", keys)[0] == known).all()
    assert (every.scores(gram, language) == few.scores(gram, language)).all()
    assert 0 < sum(x.nbytes for part in few.held.values() for x in part) <= 1_000_000


def test_model_is_the_same_for_any_layout(spark, tmp_path):
    docs = odd_docs(spark)
    kept = []
    for n in (1, 5):
        rows = quality.judged(docs.repartition(n)).collect()
        kept.append(sorted((str(r.doc_id), r.n_words, r.kept, round(r.score or 0, 4)) for r in rows))
    assert kept[0] == kept[1] and len(kept[0]) == len(ODD_ROWS)


def plain_median(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2]


def test_bands_and_verdicts_match_a_plain_version(spark):
    """``kept`` of every row, recomputed from its score and base counts."""
    rng = np.random.default_rng(8)
    letters = "etaoinshrdlu"

    def text(n, junk):
        alphabet = "qzxjkvw" if junk else letters
        return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n))

    data = [(i, text(int(rng.integers(5, 200)), i % 41 == 0), ["en", "de", None][i % 3]) for i in range(400)]
    data += [(900, None, "en"), (901, "12 34", "de"), (902, text(60, False), "alone"), (902, text(60, False), "alone")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    rows = quality.judged(docs).collect()
    assert len(rows) == len(data)
    values = defaultdict(list)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if not r.base_failed and r.score is not None:
            values[r.lang].append(int(r.score * 1000 + 0.5))
    found = set()
    for r in rows:
        wanted = False
        if not r.base_failed and r.score is not None:
            mid = plain_median(values[r.lang])
            low = plain_median([mid - v for v in values[r.lang] if v <= mid])
            high = plain_median([v - mid for v in values[r.lang] if v >= mid])
            low, high = max(low, 0.01 * mid) / 1000, max(high, 0.01 * mid) / 1000
            width = 8.0 * (1 + 50 / r.n_words) ** 0.5
            wanted = mid / 1000 - width * low <= r.score <= mid / 1000 + width * high
        assert r.kept == wanted
        found.add((r.base_failed, wanted))
    assert found == {(True, False), (False, True), (False, False)}


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in quality.judged(odd_docs(spark)).collect()}
    assert rows[3].n_words == rows[4].n_words == rows[5].n_words == 0
    assert rows[3].score is None and rows[3].base_failed and not rows[3].kept
    assert rows[8].n_words == 2 and rows[8].word_chars == 300_003 and rows[10].n_symbols == 7
    assert quality.judged(no_docs(spark)).count() == 0


def test_line_feeds_and_letters():
    assert quality.duplicate_lines("a\nb\na\n\n\n \n \nb\na") == 3
    data = np.frombuffer("12 é5 $ x".encode(), np.uint8)
    assert quality.base_counts(data, np.array([0, len(data)]))[-1].tolist() == [2]


def test_words_of_blocks_match_a_plain_split():
    texts = ["a b  c\td", "", "  x ", " y\n\nz é ü ", None, "x" * 600_000 + " b", "a b  c\td"]
    for most in (5, 1 << 21):
        counts, hashes = [], []
        for _, data, offsets in words.text_blocks(pa.array(texts), most):
            starts, ends, n = words.word_bounds(data, offsets)
            counts += n.tolist()
            hashes += words.word_hashes(data, starts, ends).tolist()
        assert counts == [len((t or "").split()) for t in texts]
        plain = [w for t in texts for w in (t or "").split()]
        assert len(set(hashes)) == len(set(plain)) == len(set(zip(plain, hashes)))
