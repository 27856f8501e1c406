import itertools

from towerlens.llm import chat

TURNS = "conv_id long, turn long, role string, text string, chunk int, merged string"


def cheapest(roles):
    """The least cost over all ways to write the turns, without the programme."""
    best = None
    for out in itertools.product(range(3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            cost, last = 0, chat.START
            for role, to, join in zip(roles, out, merged):
                cost += chat.RELABEL * (role != chat.ROLES[to])
                if join:
                    cost = cost + chat.MERGE if last == to else None
                else:
                    gap = chat._BETWEEN.get((last, to))
                    cost = None if gap is None else cost + chat.INSERT * len(gap)
                if cost is None:
                    break
                last = to
            if cost is not None:
                cost += chat.INSERT * len(chat._BEHIND[last])
                best = cost if best is None else min(best, cost)
    return best


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|") if not x.startswith("end|>") and x]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) > 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def test_every_short_conversation_is_repaired_at_least_cost(spark):
    kinds = ["system", "user", "assistant", "tool"]
    convs = [c for n in (1, 2, 3, 4) for c in itertools.product(kinds, repeat=n)]
    rows = [(i, t, r, f"t{t}", 1, "m") for i, c in enumerate(convs) for t, r in enumerate(c)]
    got = {}
    for r in chat.repaired(spark.createDataFrame(rows, TURNS)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for i, c in enumerate(convs):
        mine = sorted(got[i], key=lambda r: r.turn)
        assert sum(r.cost for r in mine) == cheapest(c), c
        text = "".join(r.rendered for r in mine)
        assert legal(text) and all(f"t{t}" in text for t in range(len(c)))


def test_chunks_give_the_same_repair(spark, monkeypatch):
    roles = [("user", "user", "assistant", "tool", "system", "assistant", "user")[i * i % 7] for i in range(200)]
    turns = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    whole = sorted(chat.repaired(turns).collect(), key=lambda r: r.turn)
    monkeypatch.setattr(chat, "CHUNK", 7)
    parts = sorted(chat.repaired(turns).collect(), key=lambda r: r.turn)
    assert sum(r.cost for r in whole) == sum(r.cost for r in parts)
    assert legal("".join(r.rendered for r in parts)) and legal("".join(r.rendered for r in whole))


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, 1, "x"), (1, 0, "user", None, 1, "x"), (1, None, "assistant", "late", 1, "x"), (2, 0, None, "", 1, None), (None, 1, "assistant", "a" * 200_000, 1, "x"), (None, 0, "user", "q", 1, "x")]
    got = chat.repaired(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == 5
    by = {}
    for r in sorted(got, key=lambda r: (r.turn is None, r.turn)):
        by[r.conv_id] = by.get(r.conv_id, "") + r.rendered
    assert by[1] == "<|user|>\n<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert by[2] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n" and legal(by[None])
    assert chat.repaired(spark.createDataFrame([], TURNS)).count() == 0
