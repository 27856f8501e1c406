"""Language identification by compression.

A text, in lower case, is compressed with one zstandard raw-content dictionary per language; the
language whose dictionary gives the fewest bytes wins. A long text is compressed in blocks of
``BLOCK_BYTES``, each with the dictionary, and the sizes are summed: a dictionary saves a bounded
number of bytes near the start, so on one long stream the winner's share would fall with the length. The
dictionaries hold labelled texts, chosen by the hash of their key: a bounded sample of
``sample_texts`` texts and ``dictionary_bytes`` bytes per language, both parameters, so they may
travel to every task. A guess is rejected if the best
language saves too little against the second.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; on equal
sizes the language that comes first by code point wins; with no labelled text at all every text
is ``und``. A single learned language always wins with score 1.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from towerlens.llm.memory import checked, drop_kept, release

UNKNOWN = "und"
SAMPLE_TEXTS = 400
DICTIONARY_BYTES = 384 << 10
LEVEL = 9
BLOCK_BYTES = 64 << 10
# The least share of bytes by which the best must beat the second to be accepted.
MARGIN = 0.005

SCHEMA = "lang_pred string, score double, accepted boolean"


def fit(docs, key="doc_id", text="text", lang="lang", sample_texts=SAMPLE_TEXTS, dictionary_bytes=DICTIONARY_BYTES):
    """Dictionaries {language: bytes} from labelled ``docs``.

    Per language the texts with the least hashes are taken, up to ``sample_texts``; texts longer
    than an eighth of the dictionary come last, as few of them would fill it. Texts are counted
    first, and only those whose hash lies below a share that holds about three times the sample
    are ranked, so what is ranked does not grow with the input.
    """
    rows = docs.select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        (F.octet_length(F.col(text)) * 8 > dictionary_bytes).cast("int").alias("long"),
        (F.xxhash64(F.col(key), F.col(text)) / F.lit(2.0**64) + 0.5).alias("h"),
    ).filter("lang is not null and text is not null and text != ''")
    shares, short = [], {}
    for r in rows.groupBy("lang", "long").agg(F.count("*").alias("n")).orderBy("long").collect():
        want = sample_texts - short.get(r["lang"], 0)
        if want > 0:
            shares.append((r["lang"], r["long"], 3.0 * want / r["n"]))
            short[r["lang"]] = r["n"]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, long int, share double")
    few = rows.join(checked(limits, len(shares)), ["lang", "long"]).filter("h < share")
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    chosen = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_texts)
    cut = F.substring(F.encode(F.lower("text"), "UTF-8"), 1, dictionary_bytes)
    found = {}
    for row in chosen.select("lang", "n", cut.alias("data")).orderBy("lang", "n").toLocalIterator():
        have = found.setdefault(row["lang"], bytearray())
        if len(have) < dictionary_bytes:
            have += bytes(row["data"])[: dictionary_bytes - len(have)] + b"\n"
    return {k: bytes(found[k]) for k in sorted(found)}


class Compressors:
    """One zstandard compressor per language."""

    def __init__(self, dictionaries, level=LEVEL):
        import zstandard

        self.names = list(dictionaries)
        self.made = []
        for data in dictionaries.values():
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.made.append(
                zstandard.ZstdCompressor(
                    level=level, dict_data=raw, write_content_size=False, write_checksum=False
                )
            )

    def sizes(self, data):
        """Bytes that each dictionary leaves of the whole of ``data``."""
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, max(len(data), 1), BLOCK_BYTES)]
        return [sum(len(c.compress(block)) for block in blocks) for c in self.made]


def judge(names, sizes, margin=MARGIN):
    """(language, score, accepted) from compressed sizes."""
    if len(names) == 1:
        return names[0], 1.0, True
    best = min(range(len(names)), key=lambda i: (sizes[i], i))
    second = min(s for i, s in enumerate(sizes) if i != best)
    score = (second - sizes[best]) / second if second else 0.0
    return names[best], score, score >= margin


def predict(docs, dictionaries, text="text", margin=MARGIN):
    """All columns of ``docs`` with lang_pred, score (0 to 1) and accepted behind them.

    A column of the input that has one of these names is replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],
        body.alias("_text"),
        body.rlike("\\p{L}").alias("_letters"),
    )
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        drop_kept()
        made = Compressors(held.value)
        for batch in batches:
            n = batch.num_columns
            found = [
                judge(made.names, made.sizes(data.as_py().lower().encode()), margin)
                if letters.as_py() and made.names
                else (UNKNOWN, 0.0, False)
                for data, letters in zip(batch.column(n - 2), batch.column(n - 1))
            ]
            langs, scores, accepted = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-2]
                + [
                    pa.array(langs, pa.string()),
                    pa.array(np.array(scores, np.float64)),
                    pa.array(accepted, pa.bool_()),
                ],
                names=[*[f"c{i}" for i in range(len(kept))], "lang_pred", "score", "accepted"],
            )
            del batch
            release()

    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    return rows.mapInArrow(run, ", ".join([*fields, SCHEMA])).toDF(
        *kept, "lang_pred", "score", "accepted"
    )
