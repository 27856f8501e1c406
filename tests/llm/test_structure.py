"""Structure repair against a plain search over all edits of one conversation at a time."""

import collections
import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tests.conftest import DATA
from towerlens.llm import conversations, structure
from towerlens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, rank string, fault int"
COUNTS = ("blank", "duplicate", "truncated")


def digest(role, text):
    r, t = role.encode(), text.encode()
    return hashlib.sha256(b"%d:%s%d:%s" % (len(r), r, len(t), t)).digest()[:16]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def search(rows):
    """(cost, audit) of rows as (role initial, fault), by trying every edit."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(at, last, inserted):
        out = []
        if at == len(rows):
            if last in ("", "a"):
                out.append((0, ""))
        else:
            initial, fault = rows[at]
            out.append((4, "D", at + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial and initial in legal[last]:
                    out.append((more, "K", at + 1, initial))
                out += [(3 + more, "R", at + 1, to) for to in "ua" if to in legal[last]]
        if inserted < 3:
            out += [(3, "I", at, to) for to in "ua" if to in legal[last]]
        found = []
        for cost, letter, *to in out:
            if not letter:
                found.append((0, ""))
            else:
                rest = best(to[0], to[1], inserted + 1 if letter == "I" else 0)
                if rest is not None:
                    found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    return best(0, "", 0)


def plain(rows, convs):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role, text))
    out = {}
    for conv in convs:
        found = sorted(own[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(*t[1:])))
        seen, kinds = set(), []
        for _, role, text in found:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append((role[:1], fault))
        numbers = [t[0] for t in found if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = search(kinds)
        lines, at = [], 0
        for letter in audit:
            user = len([x for x in lines if not x.startswith("s")]) % 2 == 0
            if letter == "I":
                lines.append("user:" if user else "assistant:")
                continue
            _, role, text = found[at]
            at += 1
            if letter == "R":
                role = "user" if user else "assistant"
            if letter != "D":
                lines.append(f"{role}:{text}")
        out[conv] = (
            gaps, *(sum(k[1] == c for k in kinds) for c in COUNTS), wrong, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(rows):
    names = ("gaps", *COUNTS, "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def found(spark, rows):
    table = structure.faults(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA))
    return table, structure.repaired(table)


def drawn(seed, convs, most):
    draw = random.Random(seed)
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "")
    texts = ("Yes.", "no", "", " \n", "Why?", "é!", "a. ", "b\t")
    return [
        (c, draw.choice((t, t, t + 3, None, 2)), draw.choice(roles), draw.choice(texts) + draw.choice(("", str(t) + ".")))
        for c in range(convs) for t in range(draw.randrange(1, most))
    ]


def test_matches_every_edit(spark):
    rows = drawn(1, 150, 12) + [(None, None, "user", "x."), (None, 1, "assistant", "y" * 200_000 + "!")]
    table, edited = found(spark, rows)
    assert got(structure.summary(table, edited).collect()) == plain(rows, {r[0] for r in rows})


@pytest.mark.parametrize("chunk", [2, 5])
def test_chunks_change_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(structure, "CHUNK", chunk)
    rows = drawn(chunk, 25, 18)
    table, edited = found(spark, rows)
    assert got(structure.summary(table, edited).collect()) == plain(rows, {r[0] for r in rows})


def test_vectors_converge_in_few_passes(spark, monkeypatch):
    monkeypatch.setattr(structure, "CHUNK", 64)
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(2_000)] + drawn(8, 3, 900)
    table = structure.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chunks, passes = structure.backward(structure._chunks(table))
    assert passes <= 4
    steps = structure.Steps()
    by = collections.defaultdict(dict)
    for r in chunks.collect():
        by[r["conv_id"]][r["chunk"]] = r
    for parts in by.values():
        vector = structure.least(structure.ENDED)
        for n in sorted(parts, reverse=True):
            assert tuple(parts[n]["behind"]) == vector
            vector = structure.run_back(steps, parts[n]["symbols"], vector)
            assert tuple(parts[n]["front"]) == vector


def test_repaired_rows_are_legal(spark):
    _, edited = found(spark, drawn(3, 40, 15))
    lines = collections.defaultdict(list)
    for r in sorted(edited.collect(), key=lambda r: (r.conv_id, r.rank, r.step)):
        if r.edit != "D":
            lines[r.conv_id].append(r)
    for rows in lines.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))
        assert all(r.text == "" and r.turn is None for r in rows if r.edit == "I")


def test_empty(spark):
    table, edited = found(spark, [])
    assert structure.summary(table, edited).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", f"a{t}. b!") for c in (0, 1, None) for t in (*range(40), None)] + [(5, 1, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = conversations.damaged(table).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, plain_damage(rows)))


def test_query(spark):
    sf = f"{DATA}/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    made = QUERIES["op12_structure_repair"](spark, sf)
    assert got(made.collect()) == plain(list(plain_damage(rows)), {r[0] for r in rows})
