import random

import pytest

from skein.llm import repetition


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def brute(tokens, need=5):
    """Share of words in second or later copies of runs of at least ``need`` words."""
    seen, cover = set(), [False] * len(tokens)
    for i in range(len(tokens) - need + 1):
        k = tuple(tokens[i : i + need])
        if k in seen:
            for j in range(i, i + need):
                cover[j] = True
        seen.add(k)
    return cover


def share(text):
    chars, covered, longest = repetition.repeated([text])
    return covered[0] / chars[0] if chars[0] else 0.0, longest[0]


@pytest.mark.parametrize("seed", range(12))
def test_against_brute_force(seed):
    r = random.Random(seed)
    base = [r.choice("abcdefgh") * r.randrange(1, 4) + str(r.randrange(3)) for _ in range(60)]
    toks = base + base[r.randrange(20) : r.randrange(25, 60)] + [f"u{i}" for i in range(10)] + base[5:17]
    cover = brute(toks)
    for i in range(2, len(toks)):
        if toks[i] == toks[i - 1] == toks[i - 2]:
            cover[i] = cover[i - 1] = True
    got, _ = share(" ".join(toks))
    assert got == pytest.approx(sum(len(t) for t, c in zip(toks, cover) if c) / sum(map(len, toks)))


def test_cases_and_signs_do_not_count():
    s = " ".join(words(8, 1))
    assert share(f"{s}. {s.upper()}! {s.replace(' ', ', ')}")[0] == pytest.approx(2 / 3)
    assert share(f"{s}. {s}")[1] == 8


def test_short_lines_words_and_scripts():
    assert share("yes\n" * 10)[0] == pytest.approx(0.9)
    assert share("spam spam spam spam " + " ".join(words(3, 2)))[0] > 0.3
    zh = "严重级别为部分服务最多等待锁定秒钟时间"
    assert share(zh + "，其他内容在这里。" + zh)[0] > 0.3
    assert share("短句不算。长")[0] == 0.0
    assert share(" ".join(words(400, 3)))[0] == 0.0


def test_documents_do_not_mix():
    s = " ".join(words(20, 4))
    chars, covered, _ = repetition.repeated([s, s, "", s + " " + s])
    assert list(covered[:3]) == [0, 0, 0] and covered[3] == chars[0] and chars[2] == 0


def test_over_tables(spark, monkeypatch):
    s = " ".join(words(30, 5))
    long = " ".join(words(60_000, 6))
    df = spark.createDataFrame([(1, s, 0.5), (2, f"{s}\n{s}\n{s}", 0.5), (3, None, 0.5), (4, "  ", 0.5), (5, long, 0.5), (2, f"{s}\n{s}\n{s}", 0.5)], "doc_id long, text string, share double")
    got = sorted((r["doc_id"], round(r["share"], 2)) for r in repetition.document_repetition(df).collect())
    assert got == [(1, 0.0), (2, 0.67), (2, 0.67), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert repetition.document_repetition(df.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_longest_repeat_against_brute_force(seed):
    r = random.Random(100 + seed)
    toks = [f"t{r.randrange(r.choice([6, 30, 200]))}" for _ in range(40)]
    want = max((k for k in range(len(toks)) if len({tuple(toks[i : i + k]) for i in range(len(toks) - k + 1)}) < len(toks) - k + 1), default=0)
    assert share(" ".join(toks))[1] == want


def test_short_longest_repeats():
    assert share("alpha beta gamma x y alpha beta gamma z")[1] == 3
    assert share("alpha beta x alpha beta")[1] == 2 and share("a b a")[1] == 1 and share("a b c")[1] == 0 and share("a")[1] == 0
    assert list(repetition.repeated(["a b", "a b", "q a q"])[2]) == [0, 0, 1]
