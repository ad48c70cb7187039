import os
import random

import pytest

from skein.llm import mix, tokens


def test_flight_keeps_totals():
    r = random.Random(1)
    size = [r.randrange(1, 500) for _ in range(3000)]
    prob = [0.3] * 3000
    p = mix.flight(prob, size, random.Random(2))
    left = [x for x in p if 0 < x < 1]
    assert len(left) <= 2
    assert sum(p) == pytest.approx(sum(prob)) and sum(a * b for a, b in zip(p, size)) == pytest.approx(sum(a * b for a, b in zip(prob, size)))
    done = mix.land(p, random.Random(3))
    assert all(x in (0.0, 1.0) for x in done)
    assert abs(sum(done) - 900) <= 2 and abs(sum(a * b for a, b in zip(done, size)) - 0.3 * sum(size)) <= 1000
    assert mix.land(mix.flight([0.5] * 4, [7.0] * 4, random.Random(0)), random.Random(1)).count(1.0) == 2


def test_inclusion_probabilities_hold():
    hits = [0] * 9
    for seed in range(3000):
        r = random.Random(seed)
        p = mix.land(mix.flight([0.2, 0.4, 0.6] * 3, [1, 2, 3, 4, 5, 6, 7, 8, 9], r), r)
        hits = [h + x for h, x in zip(hits, p)]
    assert all(abs(h / 3000 - w) < 0.05 for h, w in zip(hits, [0.2, 0.4, 0.6] * 3))


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary files")
def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 20)
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(5, 60)))
    docs = [(i, text(), "big") for i in range(300)] + [(1000 + i, text(), "small") for i in range(20)] + [(2000 + i, text(), "other") for i in range(20)] + [(3000, None, "small"), (3001, "", "big"), (3002, "x", None), (5, "same id", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.selectExpr("*", "'clash' as p", "'clash' as copies")
    t = spark.createDataFrame([("big", 0.7, None), ("small", 0.3, 3), ("absent", 0.2, 5), (None, 0.1, 1), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    got = {x["source"]: x for x in mix.shares(df, t).collect()}
    assert got["absent"]["mixed_tokens"] == 0 and set(got) == {"big", "small", "absent", "zero"}
    assert got["big"]["reached_share"] == pytest.approx(0.7, abs=0.01) and got["small"]["reached_share"] == pytest.approx(0.3, abs=0.01)
    out = mix.mix(df, t).collect()
    assert max(x["copies"] for x in out if x["source"] == "small") <= 3 and max(x["copies"] for x in out if x["source"] == "big") == 1
    assert mix.mix(df.where("false"), t).collect() == [] and mix.mix(df, t.where("false")).collect() == []
    # the same documents whatever the partitions
    key = lambda rows: sorted((x["doc_id"], x["n_tokens"], x["copies"]) for x in rows)
    assert key(out) == key(mix.mix(df.repartition(7), t).collect())
