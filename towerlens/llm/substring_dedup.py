"""Substring de-duplication by line hashing, with a sentence, a line or a paragraph as the unit.

Texts are cut at a separator. Each unit is normalised (lower case, runs of white space as one
space, none at the ends) and hashed to 128 bits; digests are grouped over all documents. The
occurrence with the smallest key, then the earliest place, stays; the others are repeats.
Neighbouring repeats form a run, and runs of at least ``min_words`` words are removed, so passages
that span several short units go, also inside a longer line, while a short unit that many texts
share stays. Spans carry character offsets into the original text.

Defined cases: a null text is empty; units of fewer than ``UNIT_WORDS`` words are never repeats by
themselves and end no run, so they go with a run around them; null keys rank last; repeated rows rank by their place in the table, so the first keeps its units; an
empty table gives an empty result. Other columns are kept by ``cleaned`` only.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.session import materialise, work_folder

MIN_WORDS = 25
UNIT_WORDS = 4
# Separators: a line feed; an empty line; a line feed or the space behind the end of a sentence.
LINE = r"\n"
PARAGRAPH = r"\n\n"
SENTENCE = r"\n|(?<=[.!?]) "
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

UNITS = "row long, doc_id long, unit int, start int, stop int, n_words int, digest binary"


def cut(text, separator):
    """(number, start, stop, words) of every unit of at least UNIT_WORDS words."""
    number, at = 0, 0
    ends = [m.span() for m in re.finditer(separator, text)]
    for stop, after in [*ends, (len(text), len(text))]:
        found = _WORD.findall(text[at:stop].lower())
        if len(found) >= UNIT_WORDS:
            yield number, at, stop, found
            number += 1
        at = after


def units(rows, separator=SENTENCE):
    """One row per unit of ``rows`` (row, doc_id, text), written once to the shared folder."""

    def run(batches):
        names = [x.split()[0] for x in UNITS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for row, key, text in zip(*batch.columns):
                row, key = row.as_py(), key.as_py()
                for number, start, stop, found in cut(text.as_py() or "", separator):
                    digest = hashlib.blake2b(" ".join(found).encode(), digest_size=16).digest()
                    out.append((row, key, number, start, stop, len(found), digest))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    path = f"{work_folder(rows.sparkSession)}/units"
    rows.mapInArrow(run, UNITS).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def repeats(found, min_words=MIN_WORDS):
    """Removed runs: row, doc_id, start, stop, n_words, n_units, keep_id (of the first unit)."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "unit")
    ranked = found.withColumn("rank", rank)
    shared = ranked.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    # Written once, so the join below has two shuffled sides and Spark may split a common line.
    shared = materialise(shared.filter("n > 1").select("digest", "best"))
    marked = ranked.join(shared, "digest").filter(F.col("rank") != F.col("best"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("unit"))
    marked = marked.withColumn("run", F.col("unit") - place)
    runs = marked.groupBy("row", "doc_id", "run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("stop").cast("long").alias("stop"),
        F.sum("n_words").alias("n_words"),
        F.count("*").alias("n_units"),
        F.min(F.struct("unit", "best.doc_id")).alias("first"),
    )
    return runs.filter(F.col("n_words") >= min_words).select(
        "row", "doc_id", "start", "stop", "n_words", "n_units", F.col("first.doc_id").alias("keep_id")
    )


def _rows(docs, key, text):
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )


def removed_spans(docs, key="doc_id", text="text", separator=SENTENCE, min_words=MIN_WORDS):
    """The spans that go: doc_id, start, stop, n_words, n_units, keep_id."""
    found = units(_rows(docs, key, text), separator)
    return repeats(found, min_words).drop("row")


def cut_out(text, spans):
    """(text without the spans, start of each kept part in the original)."""
    parts, starts, at = [], [], 0
    for start, stop in [*spans, (len(text), len(text))]:
        if start > at:
            parts.append(text[at:start])
            starts.append(at)
        at = stop
    return "".join(parts), starts


def cleaned(docs, key="doc_id", text="text", separator=SENTENCE, min_words=MIN_WORDS):
    """``docs`` without the spans, with ``kept_starts``: where each kept part began."""
    names = docs.columns
    flat = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    flat = materialise(flat)
    at, body = f"c{names.index(key)}", f"c{names.index(text)}"
    found = units(flat.select("row", F.col(at).cast("long").alias("doc_id"), F.col(body).alias("text")), separator)
    spans = repeats(found, min_words).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    kept = [f"c{i}" for i in range(len(names))]
    place = names.index(text)

    def run(batches):
        for batch in batches:
            todo = batch.column(len(names)).to_pylist()
            texts = batch.column(place).to_pylist()
            done = [
                (None, []) if t is None else cut_out(t, [(x["start"], x["stop"]) for x in s or []])
                for t, s in zip(texts, todo)
            ]
            columns = batch.columns[: len(names)]
            columns[place] = pa.array([d[0] for d in done], pa.string())
            starts = pa.array([d[1] for d in done], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, starts], names=[*kept, "kept_starts"])

    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(kept, docs.schema.fields)]
        + [T.StructField("kept_starts", T.ArrayType(T.LongType()))]
    )
    return flat.join(spans, "row", "left").select(*kept, "spans").mapInArrow(run, schema).toDF(*names, "kept_starts")
