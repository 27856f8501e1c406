"""Quality rules: base counts of a text, and the perplexity of a modified Kneser-Ney model.

The model predicts each byte of a text from the three before it, per language. Tasks count the
grams of their texts, Spark adds them up over all documents, and each lower order counts how many
grams of the next order end in it. Discounts come from the counts of counts of a language and
order. The probabilities, interpolated from below, and the back-off weights of contexts are stored
as arrays sorted by their whole key, which is the language's number, the order and the gram, so
every gram of the corpus is kept and an unseen one finds nothing. The arrays lie in files of at most
``PART_ROWS`` entries and disjoint ranges of keys. Tasks read the files from the shared folder, those
a block of text asks for; ``HELD_BYTES`` of them stay in memory, and files beyond that are read
again by each block.

A document's score is the negative log probability of its bytes per word with a letter. It is
rejected outside its language's band: the median plus or minus ``BAND`` times the median distance
of the values on that side, wider for short texts, over all documents of the language that pass
the base rules. Scores are counted in bins of a thousandth, so the medians are exact, need little
room and do not depend on the order of rows.

Defined cases: a null text is empty; a null language is a language of its own; a text without a
letter has no score and is rejected; a language whose scores hardly differ gets a band of
``LEAST_SPREAD`` of its median; repeated rows are scored and counted each for itself; an empty
table gives an empty result. Other columns are kept by ``filtered`` only.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens.llm import words
from towerlens.llm.memory import checked, kept
from towerlens.session import materialise, work_folder

ORDER = 4
# Entries of one file of the model, and bytes of files that a worker keeps.
PART_ROWS = 1 << 20
HELD_BYTES = 256 << 20
BAND = 8.0
# A text of so many words has a band wider by the root of two.
SHORT_WORDS = 50
LEAST_SPREAD = 0.01
BIN = 1000
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED = 30
NO_LANGUAGE = ""
PARTS = 256

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # first bytes of letters beyond ASCII, and of few other signs

BASE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "letter_words long"
)


def _per_text(flags, offsets):
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(text):
    """Lines with a word that equal an earlier line."""
    return sum(n - 1 for line, n in Counter(text.split("\n")).items() if n > 1 and line.strip(" \t\n\v\f\r"))


def repeated_words(hashes, counts, width=REPEAT_WINDOW):
    """Per text, the words inside windows of ``width`` words that occur twice or more in it."""
    per = np.maximum(counts - width + 1, 0)
    out = np.zeros(len(counts), np.int64)
    if per.sum() == 0:
        return out
    windows, every = words.shingles(hashes, counts, width)
    windows = windows[np.repeat(counts >= width, every)]
    text = np.repeat(np.arange(len(counts)), per)
    base = np.cumsum(counts) - counts
    start = np.repeat(base - (np.cumsum(per) - per), per) + np.arange(len(windows))
    order = np.lexsort((windows, text))
    same = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, start[twice], 1)
    np.add.at(step, start[twice] + width, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts)[covered], minlength=len(counts))


def base_counts(data, offsets):
    """The columns of BASE for the texts of one block."""
    starts, ends, counts = words.word_bounds(data, offsets)
    solid = ~words._SPACE[data]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    lettered = np.bincount(
        np.repeat(np.arange(len(counts)), counts)[letters[ends] > letters[starts]], minlength=len(counts)
    )
    raw = data.tobytes()
    lines = [duplicate_lines(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
    return [
        counts,
        _per_text(solid & ((data & 0xC0) != 0x80), offsets),
        _per_text(_SYMBOL[data], offsets),
        np.array(lines, np.int64),
        repeated_words(words.word_hashes(data, starts, ends), counts),
        lettered,
    ]


def grams(data, offsets):
    """(grams of ORDER bytes as numbers, bytes per text); line feeds stand before a text."""
    sizes = np.diff(offsets)
    pad = ORDER - 1
    wide = np.full(len(data) + pad * len(sizes), 10, np.uint8)
    shift = np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)
    place = np.arange(len(data)) + shift
    wide[place] = data
    out = np.zeros(len(data), np.uint32)
    for k in range(ORDER):
        out = (out << np.uint32(8)) | wide[place - pad + k]
    return out, sizes


def gram_counts(docs, text="text", lang="lang"):
    """lang, gram and n over all of ``docs``; tasks add up their own grams first."""

    def run(batches):
        names, keys, totals = {}, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            number = np.array([names.setdefault(x, len(names)) for x in langs], np.uint64)
            for first, data, offsets in words.text_blocks(batch.column(1)):
                gram, sizes = grams(data, offsets)
                of = np.repeat(number[first : first + len(sizes)], sizes)
                new, n = np.unique((of << np.uint64(8 * ORDER)) | gram, return_counts=True)
                both = np.concatenate([keys, new])
                keys, back = np.unique(both, return_inverse=True)
                totals = np.bincount(back, np.concatenate([totals, n]), len(keys)).astype(np.int64)
        texts = pa.array(list(names), pa.string())
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    texts.take(pa.array((part >> np.uint64(8 * ORDER)).astype(np.int64))),
                    pa.array((part & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)),
                    pa.array(totals[at : at + (1 << 16)]),
                ],
                names=["lang", "gram", "n"],
            )

    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(table):
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, per language."""
    n = [F.greatest(F.count_if(F.col("n") == i), F.lit(1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return table.groupBy("lang").agg(*n).select(
        "lang",
        *[
            F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).alias(f"d{i}")
            for i in (1, 2, 3)
        ],
    )


def probabilities(counts):
    """order, lang, gram, n, p of every gram, and order, lang, context, gamma, total of contexts."""
    tables = {ORDER: materialise(counts)}
    for order in range(ORDER - 1, 0, -1):
        low = (F.col("gram") % (1 << 8 * order)).alias("gram")
        tables[order] = materialise(tables[order + 1].select("lang", low).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    grams_, contexts, below = [], [], None
    for order in range(1, ORDER + 1):
        table = tables[order]
        # Discounts are repeated over parts, so the grams of one language are joined by many tasks.
        part = F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int")
        cuts = _discounts(table).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = table.withColumn("part", part).join(cuts, ["lang", "part"]).drop("part")
        rows = rows.withColumn("context", F.floor(F.col("gram") / 256))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("cut", cut)
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        sums = sums.select("lang", "context", "total", (F.col("freed") / F.col("total")).alias("gamma"))
        rows = rows.join(sums, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            suffix = F.col("gram") % (1 << 8 * (order - 1))
            low = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", suffix).join(low, ["lang", "suffix"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")
        below = materialise(rows.select("lang", "gram", "n", p.alias("p")))
        grams_.append(below.withColumn("order", F.lit(order)))
        contexts.append(sums.withColumn("order", F.lit(order)))
    first = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionAll(first(frames[1:]))
    return first(grams_), first(contexts)


def keys(gram, order, language):
    """Language, order and gram as one number; unknown languages (-1) give numbers below zero."""
    return (language << (8 * ORDER + 3)) + (order << 8 * ORDER) + gram


def write_model(docs, folder, text="text", lang="lang"):
    """Count, estimate and store the model of ``docs`` in ``folder``."""
    found, contexts = probabilities(gram_counts(docs, text, lang))
    # Every language has grams of order 1, at most 256 of them.
    names = sorted(r["lang"] for r in found.filter(F.col("order") == 1).select("lang").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "lang string, number long")
    numbers.coalesce(1).write.mode("overwrite").parquet(f"{folder}/languages")
    for name, frame, gram, value in (("grams", found, "gram", "p"), ("contexts", contexts, "context", "gamma")):
        key = F.shiftleft("number", 8 * ORDER + 3) + F.shiftleft(F.col("order").cast("long"), 8 * ORDER) + F.col(gram)
        log = F.log(F.greatest(F.col(value), F.lit(1e-12))).cast("float")
        rows = frame.join(checked(numbers, len(names)), "lang").select(key.alias("key"), log.alias("value"))
        rows = rows.repartitionByRange("key").sortWithinPartitions("key")
        rows.write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).parquet(f"{folder}/{name}")


class Model:
    """Sorted arrays of a stored model, read by file as they are asked for."""

    def __init__(self, folder):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.store, base = fs.FileSystem.from_uri(folder)
        table = pq.read_table(f"{base}/languages", filesystem=self.store)
        self.numbers = dict(zip(table["lang"].to_pylist(), table["number"].to_pylist()))
        self.parts, self.held, self.room = {}, {}, HELD_BYTES
        for name in ("grams", "contexts"):
            parts = []
            for file in self.store.get_file_info(fs.FileSelector(f"{base}/{name}")):
                if not file.path.endswith(".parquet"):
                    continue
                about = pq.read_metadata(file.path, filesystem=self.store)
                ranges = [about.row_group(i).column(0).statistics for i in range(about.num_row_groups)]
                if ranges:
                    parts.append((min(r.min for r in ranges), max(r.max for r in ranges), file.path))
            self.parts[name] = sorted(parts)

    def _part(self, path):
        import pyarrow.parquet as pq

        if path in self.held:
            return self.held[path]
        with self.store.open_input_file(path) as file:
            table = pq.ParquetFile(file).read()
        found = table["key"].to_numpy(), table["value"].to_numpy()
        size = sum(x.nbytes for x in found)
        if size <= self.room:
            self.held[path] = found
            self.room -= size
        return found

    def _find(self, name, key):
        """(whether it is there, value) of each key."""
        asked, back = np.unique(key, return_inverse=True)
        hit, value = np.zeros(len(asked), bool), np.zeros(len(asked), np.float32)
        for low, high, path in self.parts[name]:
            a, b = np.searchsorted(asked, low), np.searchsorted(asked, high, side="right")
            if a < b:
                have, values = self._part(path)
                at = np.searchsorted(have, asked[a:b])
                hit[a:b], value[a:b] = have[at] == asked[a:b], values[at]
        return hit[back], value[back]

    def scores(self, gram, language):
        """Log probability of the last byte of each gram; ``language`` holds numbers of languages."""
        both, back = np.unique((language << 8 * ORDER) + gram.astype(np.int64), return_inverse=True)
        language, gram = both >> 8 * ORDER, both & ((1 << 8 * ORDER) - 1)
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            low = gram[todo] & ((1 << 8 * order) - 1)
            hit, value = self._find("grams", keys(low, order, language[todo]))
            out[todo[hit]] += value[hit]
            todo, low = todo[~hit], low[~hit]
            if len(todo) == 0:
                break
            hit, value = self._find("contexts", keys(low >> 8, order, language[todo]))
            out[todo[hit]] += value[hit]
        out[todo] += np.log(1 / 256)
        return out[back]


def scored(docs, folder, key="doc_id", text="text", lang="lang"):
    """doc_id, lang, BASE columns and ``score``, the negative log probability per lettered word."""

    def run(batches):
        model = kept("language model", folder, lambda: Model(folder))
        for batch in batches:
            number = np.array([model.numbers.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for first, data, offsets in words.text_blocks(batch.column(2)):
                base = base_counts(data, offsets)
                gram, sizes = grams(data, offsets)
                logs = model.scores(gram, np.repeat(number[first : first + len(sizes)], sizes))
                total = np.concatenate([[0.0], np.cumsum(logs)])
                total = total[offsets[1:]] - total[offsets[:-1]]
                lettered = base[-1]
                score = np.where(lettered > 0, -total / np.maximum(lettered, 1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        batch.column(1).slice(first, len(sizes)),
                        *[pa.array(x.astype(np.int64)) for x in base],
                        pa.array(score, from_pandas=True),
                    ],
                    schema=pa.schema(
                        [("doc_id", pa.int64()), ("lang", pa.string())]
                        + [(x.split()[0], pa.int64()) for x in BASE.split(", ")]
                        + [("score", pa.float64())]
                    ),
                )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(run, f"doc_id long, lang string, {BASE}, score double")


def bands(rows):
    """lang, middle, below, above of rows that pass the base rules: the median score of a language and
    the median distances from it on both sides, all in bins. One row per language, made by Spark."""
    at = F.round(F.col("score") * BIN).cast("long")
    binned = rows.filter("not base_failed and score is not null").select("lang", at.alias("bin"))
    middles = materialise(binned.groupBy("lang").agg(_median("bin").alias("mid")))
    spreads = binned.join(checked(middles, middles.count()), "lang").groupBy("lang", "mid").agg(
        _median("CASE WHEN bin <= mid THEN mid - bin END").alias("low"),
        _median("CASE WHEN bin >= mid THEN bin - mid END").alias("high"),
    )
    middle, least = F.col("mid") / BIN, LEAST_SPREAD * F.col("mid")
    return spreads.select(
        "lang",
        middle.alias("middle"),
        (F.greatest("low", least) / BIN).alias("below"),
        (F.greatest("high", least) / BIN).alias("above"),
    )


def _median(value):
    """The least value that half of the rows do not exceed; a task holds one count per value, nulls none."""
    return F.expr(f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {value}) AS BIGINT)")


def judged(docs, key="doc_id", text="text", lang="lang", folder=None, band=BAND):
    """Base counts, score, base_failed and kept of every row of ``docs``."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{work_folder(spark)}/model"
        write_model(docs, folder, text, lang)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialise(scored(docs, folder, key, text, lang).withColumn("base_failed", failed))
    limits = materialise(bands(rows))
    width = band * F.sqrt(1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.col("score").between(
        F.col("middle") - width * F.col("below"), F.col("middle") + width * F.col("above")
    )
    return rows.join(checked(limits, limits.count()), "lang", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    )
