import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def tables():
    return tokens.WordTables(tokens.MergeAutomaton(tokens.read_ranks(tokens.DEFAULT_VOCABULARY)))


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("judge", pat_str=pattern, mergeable_ranks=tokens.read_ranks(tokens.DEFAULT_VOCABULARY), special_tokens={})


def encode(tables, texts):
    ids, ends = tables.encode(texts)
    starts = [0, *ends[:-1]]
    return [ids[a:b].tolist() for a, b in zip(starts, ends)]


def test_known_texts(tables, judge):
    texts = ["", " ", "a", "it's'", "' '", " 's", "\n's\n\n ", "don't you'll we've I'M", "a" * 5000, "ab " * 900, "<|endoftext|>", "日本語のテキスト。", "e\u0301\u200d😀", "\u00a0\u3000x\t\t y", "x\r\n\r\n  y  \n", "0x1F 12345,678.90"]
    assert encode(tables, texts) == [judge.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevmdl  \n\tAZaz09.,-_é日\u00a0"), st.characters(exclude_categories=("Cs",)))), max_size=4))
def test_equals_reference_encoder(tables, judge, texts):
    assert encode(tables, texts or [""]) == [judge.encode_ordinary(t) for t in texts or [""]]


def test_round_trip_and_small_automaton(tables):
    word = "unbelievable résumé".encode()
    assert tables.automaton.decode(tables.automaton.walk(word)) == word
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aab": 257, b"ba": 258}
    a = tokens.MergeAutomaton(ranks)

    def brute(s):
        parts = [bytes([c]) for c in s]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1 << 9):
        s = bytes(b"ab"[(n >> k) & 1] for k in range(9))
        assert a.walk(s) == brute(s), s


def test_tables_forget(tables, monkeypatch, judge):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    for t in ("one two three four five", "six seven one two", "one"):
        assert encode(tables, [t]) == [judge.encode_ordinary(t)]


def test_over_tables(spark, judge):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df).collect())
    assert got == [(1, judge.encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])]
    assert sorted(tuple(r) for r in tokens.token_counts(df, ["doc_id"]).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert [r["text"] for r in tokens.decoded(tokens.token_ids(df.limit(1))).collect()] == ["hello world"]
    assert tokens.token_ids(df.where("false")).collect() == []


def test_vocabulary_reader(tmp_path):
    p = tmp_path / "v"
    p.write_bytes(base64.b64encode(b"ab") + b" 7\n")
    assert tokens.read_ranks(str(p)) == {b"ab": 7}


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary files")
def test_decoding_of_odd_lists(spark):
    rows = [(1, []), (2, None), (3, [0, 1, 2]), (4, [200]), (3, [0])]
    got = [(r["doc_id"], r["text"]) for r in tokens.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()]
    label = tokens.MergeAutomaton(tokens.read_ranks(tokens.DEFAULT_VOCABULARY)).label
    text = lambda ids: b"".join(label[i] for i in ids).decode("utf-8", "replace")
    assert sorted(got, key=repr) == sorted([(i, None if x is None else text(x)) for i, x in rows], key=repr)
