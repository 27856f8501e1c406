import random

import pytest

from tests.llm.helpers import ODD_ROWS, no_docs, odd_docs
from towerlens.llm import language


@pytest.mark.parametrize("names, sizes, expected", [
    (["a"], [9], ("a", 1.0, True)),
    (["a", "b"], [10, 20], ("a", 0.5, True)),
    (["a", "b"], [20, 20], ("a", 0.0, False)),
    (["a", "b", "c"], [1000, 999, 1000], ("b", 0.001, False)),
])
def test_judge(names, sizes, expected):
    name, score, accepted = language.judge(names, sizes)
    assert (name, accepted) == (expected[0], expected[2]) and score == pytest.approx(expected[1])


def test_fit_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame(
        [(i, f"text number {i} of many " * 9, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, lang string"
    )
    one = language.fit(docs, sample_texts=20, dictionary_bytes=1500)
    assert list(one) == ["a", "b"] and all(0 < len(v) <= 1501 for v in one.values())
    assert one == language.fit(docs.repartition(7), sample_texts=20, dictionary_bytes=1500)


def test_long_texts_keep_their_margin():
    rng = random.Random(4)
    stocks = {k: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)] for k in "xy"}
    text = lambda k, n: " ".join(rng.choices(stocks[k], k=n)).encode()
    made = language.Compressors({k: text(k, 8_000) for k in stocks})
    short, long = text("y", 8_000), text("y", 1_400_000)
    scores = []
    for data in (short, long):
        name, score, accepted = language.judge(made.names, made.sizes(data))
        assert (name, accepted) == ("y", True)
        scores.append(score)
    assert len(short) < language.BLOCK_BYTES and scores[1] > scores[0] / 2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = language.predict(docs, language.fit(docs))
    assert sorted(found.columns) == sorted({*docs.columns, "lang_pred", "score", "accepted"})
    rows = found.collect()
    assert len(rows) == len(ODD_ROWS)
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("en", "de", "fr", "es") and 0 <= r.score <= 1
    assert language.predict(no_docs(spark), language.fit(no_docs(spark))).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
