import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_ROWS, no_docs, odd_docs
from towerlens.llm import packing, token_files
from towerlens.llm.tokens import WordTokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_each_bin_is_the_fullest_with_its_longest_piece(lengths):
    left = sorted(lengths, reverse=True)
    counts = {n: lengths.count(n) for n in set(lengths)}
    for times, uses in packing.fill_bins(counts, 12):
        for _ in range(times):
            seed, rest = left[0], left[1:]
            sums = {sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k)}
            best = max(s for s in sums if s + seed <= 12) + seed
            assert sum(n * u for n, u in uses.items()) == best
            for n, u in uses.items():
                for _ in range(u):
                    left.remove(n)
    assert left == []


def test_odd_rows_and_clashing_names(spark):
    pieces = packing.pieces(odd_docs(spark), TOKENIZER, 64)
    clash = pieces.withColumns({"sequence_id": F.lit("mine"), "_row": F.lit(1), "p0": F.lit(2)})
    rows = packing.place(clash, 64).collect()
    assert {r.sequence_id for r in rows} == {"mine"}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id_packed, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.piece == 0 for r in rows) == len(ODD_ROWS)
    whole = packing.sequences(packing.place(pieces, 64)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_no_pieces(spark):
    assert packing.place(packing.pieces(no_docs(spark), TOKENIZER)).count() == 0


def test_token_files_of_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write(odd_docs(spark), path, TOKENIZER)
    rows = token_files.read(spark, path).collect()
    assert len(rows) == len(ODD_ROWS) and all(r.ids[-1] == 0 == r.ids.count(None) for r in rows)
    assert [r.ids for r in rows if r.doc_id in (3, 4)] == [[0], [0]]
    some = token_files.read_documents(spark, path, 5, 6)
    assert sorted(r.doc_id for r in some.collect()) == [5, 6]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    lengths = token_files.read_lengths(spark, path)
    assert lengths.count() == len(ODD_ROWS)
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    token_files.write(no_docs(spark), f"{path}-none", TOKENIZER)
    assert token_files.digests(spark, f"{path}-none").count() == 0


ATOMS = ["a", "foo", "Bar", "é", "×", "12", "'", "'s", "\"", ".", ",", "(", "|", "<", "<|endoftext|>", "\n", "\n\n", "\r\n"]
ATOMS += ["\t", " ", " ", "  ", "\u00a0", "\u3000", "\x00", "’", "«", "я", "中", "\u0301", "²", "_", "ł", "ª"]


def _ids(encoder, texts):
    out = []
    for _, ids, counts in encoder.blocks(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ATOMS), max_size=9).map("".join), min_size=1, max_size=6))
def test_parts_have_the_ids_of_whole_texts(texts):
    for encoder in ENCODERS:
        plain = [e.ids + [0] for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
        assert _ids(encoder, texts) == plain


PLAIN, ENCODERS = Tokenizer.from_file(TOKENIZER), [WordTokenizer(TOKENIZER) for _ in range(2)]
ENCODERS[1].fine = False


def test_words_are_learnt_without_signs_and_line_feeds():
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "aeiou" for c in "lmnr"]
    tails = [".", ",", ";", "!", ".\nThe", ":\nOne", "\nBut", ")", "?"]
    encoder = WordTokenizer(TOKENIZER)
    list(encoder.blocks(pa.array([" ".join(f"on {w}{t} by" for w in words for t in tails)])))
    assert len(encoder.known) < 2 * len(words)
