import numpy as np
import pytest

from tests.llm.helpers import ODD_ROWS, no_docs, odd_docs, words
from towerlens.llm import mixing


def test_targets_share_what_full_sources_leave():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 10], [5, 2], 100) == [20, 20]
    assert mixing.targets([0, 50], [5, 2], 75) == [0, 75]
    assert mixing.targets([], [], 0) == []


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(count):
    got = mixing.permuted(np.arange(count), count, 7)
    assert sorted(got) == list(range(count))
    if count > 60:
        assert not np.array_equal(got, mixing.permuted(np.arange(count), count, 8))
        assert not np.array_equal(got, np.arange(count))


def test_quotas_are_met_over_many_shards(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 40), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string"
    )
    plan = mixing.Plan(mixing.sized(docs), block_words=8)
    rows = mixing.slots(plan, 5, shard_slots=50).collect()
    assert len(rows) == sum(plan.quotas) and len({r.shard for r in rows}) == -(-len(rows) // 50)
    for s, quota in enumerate(plan.quotas):
        mine = [(r.turn, r.block) for r in rows if r.source_no == s]
        assert len(mine) == len(set(mine)) == quota
        assert {t for t, _ in mine} <= {0, 1}
        assert len({b for t, b in mine if t == 0}) == min(quota, plan.blocks[s])
    # Shards get different shares, as drawn, not the same split each.
    shares = [sum(r.shard == h and r.source_no == 0 for r in rows) for h in range(4)]
    assert len(set(shares)) > 1
    spans = mixing.spans(docs, 5, plan, shard_slots=50).filter("shard is not null").collect()
    for s in range(3):
        blocks = {}
        for r in spans:
            if r.source_no == s:
                blocks.setdefault((r.turn, r.block), []).append(r.n_words)
        full = [sum(v) for (t, b), v in blocks.items() if b < plan.blocks[s] - 1]
        assert set(full) <= {8}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted(r["size"] for r in rows) == sorted(len(words(x[1])) for x in ODD_ROWS)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert sum(len(words(r.text)) for r in got) == sum(r.taken for r in rows)
    text = {}
    for key, body, *_ in ODD_ROWS:
        text.setdefault(key, set()).update(words(body))
    assert all(set(words(r.text)) <= text[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert mixing.taken(no_docs(spark)).count() == mixing.mixed_documents(no_docs(spark)).count() == 0


def plain_taken(rows, plan, seed):
    """doc_id to words taken, slot by slot, for documents of one numbering group."""
    out = {key: 0 for key, *_ in rows}
    for s, name in enumerate(plan.names):
        owner = [key for key, text, source in sorted(rows) if source == name for _ in words(text)]
        for k in range(plan.quotas[s]):
            (block,), _ = mixing.blocks_of(plan, s, np.array([k]), seed)
            size = plan.cuts[s] if k == plan.quotas[s] - 1 else plan.block_words
            for key in owner[block * plan.block_words :][: min(size, plan.block_words)]:
                out[key] += 1
    return out


@pytest.mark.parametrize("shard_slots", [3, 4096])
def test_taken_against_a_plain_count(spark, shard_slots):
    rows = [(i, "w " * (i * 7 % 90), "abcde"[min(i % 9, 4)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.Plan(mixing.sized(docs), block_words=32)
    assert plan.groups == 1 and min(plan.blocks) <= mixing.CUT_BLOCKS < max(plan.blocks)
    got = {r.doc_id: r.taken for r in mixing.taken(docs, 3, plan=plan, shard_slots=shard_slots).collect()}
    assert got == plain_taken(rows, plan, 3)
    assert all(n <= 2 * len(words(t)) for (_, t, _), n in zip(rows, (got[i] for i in range(400))))


def test_many_small_sources_meet_their_targets(spark):
    rows = [(i, "w " * 20, f"s{i:03d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.taken(docs).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.taken <= 40 for r in found) and len(found) == 200
    again = {r.doc_id: r.taken for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_slots_of_one_source_are_dealt_to_many_tasks(spark):
    docs = spark.createDataFrame([(i, "w " * 600, "a") for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.Plan(mixing.sized(docs), block_words=2)
    made = mixing.slots(plan, 1).selectExpr("spark_partition_id() AS p", "shard").distinct().collect()
    shards = {r.shard for r in made}
    assert len(shards) > 3 * mixing.TASK_SHARDS
    assert len({r.p for r in made}) >= len(shards) // (3 * mixing.TASK_SHARDS)
