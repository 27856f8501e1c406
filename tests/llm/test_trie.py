"""The prefix tree against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from towerlens.llm import conversations, prefix_trie, turns

SCHEMA = "conv_id long, turn long, role string, text string, g1 string, part int"
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    r, t = role.encode(), text.encode()
    return hashlib.sha256(b"%d:%s%d:%s" % (len(r), r, len(t), t)).digest()[:16]


def plain(rows):
    """{(smallest member, depth, parent's, ...)} by a dictionary that holds every prefix whole."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role or "", text or ""))
    for found in own.values():
        found.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(*t[1:])))
    made = {}
    for conv, found in own.items():
        h = 0 if conv is None else zlib.crc32(str(conv).encode()) % 9
        base = [] if conv is None else own.get(conv - conv % 5, [])
        made[conv] = [t[1:] for t in base[:h]] + [t[1:] for t in found[h:]]
    members = collections.defaultdict(list)
    for conv, found in made.items():
        for depth in range(len(found) + 1):
            members[tuple(found[:depth])].append(conv)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for prefix, convs in members.items():
        more = (len(convs) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        for depth in range(len(prefix) + 1):
            saved[prefix[:depth]] += more
            leaves[prefix[:depth]] += not kids[prefix]

    def least(convs):
        return min((c for c in convs if c is not None), default=None)

    out = []
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if c is not None and len(made[c]) == len(prefix)))
        out.append(
            (least(convs), len(prefix), least(members[prefix[:-1]]) if prefix else None, len(convs), kids[prefix],
             leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return prefix_trie.nodes(conversations.rebuilt(table), conversations.members(table), ("section", "place"))


ODD = [
    (0, None, None, None), (0, None, "user", "b"), (0, 1, "user", ""), (0, 1, "user", ""), (0, 2, "a", "é" * 40_000),
    (1, 0, "user", "x"), (1, 0, "assistant", "y"), (1, 0, "user", "a"), (2, 5, "user", "only"),
    (3, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "user", "r"), (7, 0, "user", "x"),
    *[(c, t, "user", f"same {t}") for c in (10, 11, 12, 13, 14, 15, 25) for t in range(12)],
]


def test_odd_rows(spark):
    assert ordered(found(spark, ODD).collect()) == ordered(plain(ODD))


def test_empty(spark):
    assert found(spark, []).collect() == []


def test_long_conversations_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHILDREN_FLOOR", 3)
    monkeypatch.setattr(prefix_trie, "CHILDREN_SHARE", 1 << 40)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 10)
    draw = random.Random(5)
    long = [(c, t, "user", f"turn {t if t < cut else draw.random()}") for c, cut in ((5, 0), (6, 200), (8, 90)) for t in range(260)]
    short = [(c, t, "user", draw.choice("ab")) for c in range(100, 160) for t in range(draw.randrange(1, 14))]
    rows = long + short
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch",
             "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("23", "7", "false")):
            spark.conf.set(name, value)
        assert ordered(found(spark, rows).collect()) == ordered(plain(rows))
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_full_sketch_changes_nothing(spark, monkeypatch):
    """With a sketch that proves nothing, all prefixes are grouped."""
    monkeypatch.setattr(prefix_trie, "proven_single", lambda table, g1, g2: np.zeros(len(g1), bool))
    assert ordered(found(spark, ODD).collect()) == ordered(plain(ODD))


@pytest.mark.parametrize("distinct", [10, 50_000])
def test_sketch_never_counts_too_few(spark, distinct):
    rows = [(c, t, "user", f"{c % distinct} {t}") for c in range(distinct * 2 if distinct < 100 else 3000) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = turns.placed(turns.ordered_turns(table), turns.turn_order())
    found, _ = turns.carries(placed)
    bits = prefix_trie.sketch(placed, found, prefix_trie.cell_count(len(rows)))
    at = {n: i for i, n in enumerate(placed.columns)}
    batch = placed.toArrow().to_batches()
    single = sum(
        int(prefix_trie.proven_single(bits, *prefix_trie._resolved(b, found if len(batch) == 1 else {}, at)[3:]).sum())
        for b in batch
    )
    assert single == 0 if distinct < 100 else single > 0.9 * len(rows)
