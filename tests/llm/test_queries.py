"""Every registered query of the subpackage: against DuckDB, or its contract, on real tables."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.helpers import words
from tests.test_oracle import canonical, expected
from towerlens.llm.queries import ORACLE, QUERIES

SF = f"{DATA}/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def ids():
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = table("documents", "doc_id, text")
    found = encoder.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return {d: np.array([*e.ids, 0], "<u4") for (d, _), e in zip(rows, found)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    names, rows = expected(SF, ORACLE[name])
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.collect(), got.columns) == canonical(rows, names)


def test_packing_holds_every_piece_once(spark, ids):
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == ids.keys()
    for key, parts in docs.items():
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at)
            assert crc == zlib.crc32(ids[key][start : start + length].tobytes())
            assert length == 2048 or n == 0
            at += length
        assert at == len(ids[key])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) for x in ids.values())
    assert len(bins) <= -(-total // 2048) + 1


def test_token_files_give_the_ids_back(spark, ids):
    rows = QUERIES["op3_token_files"](spark, SF).collect()
    at = 0
    assert len(rows) == len(ids)
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens) == (at, len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id].tobytes())
        at += r.n_tokens


def test_mix_comes_near_its_targets(spark):
    source = dict(table("documents", "doc_id, source"))
    rows = QUERIES["op6_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(QUERIES["op6_mixing"](spark, SF).collect())
    assert {r.doc_id for r in rows} == set(source)
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
        assert r.source_size > 0
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    for s, goal in target.items():
        assert goal <= 2 * size[s] + 1e-6
        assert abs(taken[s] - goal) <= 256


def test_base_counts_match_a_plain_version(spark):
    text = dict(table("documents", "doc_id, text"))
    rows = QUERIES["op8_quality"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        found = words(text[r.doc_id])
        windows = collections.Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
        inside = set()
        for i in range(len(found) - 7):
            if windows[tuple(found[i : i + 8])] > 1:
                inside.update(range(i, i + 8))
        lines = [x for x in text[r.doc_id].split("\n") if words(x)]
        failed = len(found) < 20 or 100 * len(inside) > 30 * len(found)
        assert (r.n_words, r.word_chars) == (len(found), sum(map(len, found)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text[r.doc_id])
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == failed and not (failed and r.kept)


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = f"{DATA}/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES["op8_quality"](spark, sf).collect()
    clean = [r.kept for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in rows if label.get(r.doc_id) == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(junk) <= 0.1 * len(junk)


def test_language_of_held_out_documents(spark):
    sf = f"{DATA}/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)
