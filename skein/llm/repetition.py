"""Repetition inside a single document (problem 10).

The words of a document (single characters in scripts without spaces; letter
case, spacing and punctuation don't count) are put in suffix order by prefix
doubling, for all documents of an Arrow batch at once.  Neighbouring suffixes
and their longest common prefixes give the intervals of repeated substrings;
what lies in a second or later copy of a passage is marked, and the marks'
union is the covered part.  Suffixes that differ from all others after a few
words leave the sort early, so ordinary text costs three rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import spread

#: A passage is so long: a word counts 2, a character of a script without spaces 1.
PASSAGE = 10
#: Share of the characters in second or later copies from which a document is reported.
LIMIT = 1 / 3
#: Characters handled at once; longer batches are cut between documents.
CHUNK = 1 << 20

_tables: list = []


def _char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: kind (0 none, 1 word, 2 word of its own), lower case, and salt."""
    if not _tables:
        kind = np.zeros(0x110000, np.uint8)
        low = np.arange(0x110000, dtype=np.uint32)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            chars = "".join(map(chr, range(lo, hi)))
            for m in regex.finditer(r"[\p{L}\p{N}\p{M}_]+", chars):
                kind[lo + m.start() : lo + m.end()] = 1
            for m in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+", chars):
                span = kind[lo + m.start() : lo + m.end()]
                span[span == 1] = 2
        for i in range(0x20000):
            if not 0xD800 <= i < 0xE000:
                c = chr(i).lower()
                if len(c) == 1:
                    low[i] = ord(c)
        salt = np.random.default_rng(11).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        _tables.append((kind, low, salt))
    return _tables[0]


_powers: list = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        base = 0xD6E8FEB86659FD93
        with np.errstate(over="ignore"):
            _powers[:] = [(np.cumprod(np.full(2 * n, base, np.uint64)), np.cumprod(np.full(2 * n, pow(base, -1, 1 << 64), np.uint64)))]
    return _powers[0]


def _prints(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A fingerprint of each slice of ``values``."""
    up, back = _power(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return (total[stops] - total[starts]) * back[starts]


def _classes(keys: np.ndarray) -> np.ndarray:
    """Dense ranks in the order of ``keys``."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _suffix_rounds(word: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Classes of the word strings of length 1, 2, 4, ... at each place, and the final suffix ranks.

    Strings never leave their document: beyond its end a place ranks below all.
    """
    n = len(word)
    levels = [word]
    rank = word
    size = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        if size < n:
            same = doc[:-size] == doc[size:]
            nxt[:-size][same] = rank[size:][same]
        rank = _classes((rank * (n + 2)) + nxt + 1)
        levels.append(rank)
        size *= 2
        if rank.max(initial=0) == n - 1 or size > n:
            return levels, rank


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b`` (places of one document each)."""
    n = len(doc)
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    last = np.searchsorted(doc, doc, side="right")  # end of each place's document
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        fit = (a < n) & (b < n)
        fit[fit] = (last[a[fit]] - a[fit] >= size) & (last[b[fit]] - b[fit] >= size)
        fit[fit] = levels[k][a[fit]] == levels[k][b[fit]]
        a[fit] += size
        b[fit] += size
        out[fit] += size
    return out


def _again(classes: np.ndarray) -> np.ndarray:
    """Where a class stands that occurs more than once."""
    return np.bincount(classes)[classes] > 1


def repeated(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, covered, longest) of each text: word characters, those in later copies, words of the longest repeat."""
    kind_of, low, salt = _char_tables()
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    ends = np.cumsum(sizes + 1)
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kind_of[cp]
    before = np.concatenate([[0], kind[:-1]])
    starts = np.flatnonzero((kind > 0) & ((before == 0) | (kind == 2) | (before == 2)))
    chars, covered, longest = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    n = len(starts)
    if n == 0:
        return chars, covered, longest
    after = np.concatenate([kind[1:], [0]])
    stops = np.flatnonzero((kind > 0) & ((after == 0) | (kind == 2) | (after == 2))) + 1
    doc = np.searchsorted(ends, starts, side="right")
    weight = stops - starts
    single = kind[starts] == 2
    word = pd.factorize(_prints(salt[low[cp]], starts, stops))[0].astype(np.int64)
    chars += np.bincount(doc, weight, m).astype(np.int64)
    # class 0 of the sort: word and document together
    own = pd.factorize(doc * (word.max() + 1) + word)[0].astype(np.int64)
    cover = np.zeros(n, bool)
    # one word over and over
    if n > 2:
        twice = own[1:] == own[:-1]
        run = twice[1:] & twice[:-1]
        cover[2:] |= run
        cover[1:-1] |= run
    # lines and sentences, however short
    stop = (cp == 10) | (cp == 13) | (cp == 33) | (cp == 63) | (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F) | (cp == 0x2028) | (cp == 0x2029)
    stop |= (cp == 46) & (np.concatenate([kind[1:], [0]]) == 0)
    seen = np.concatenate([[0], np.cumsum(stop)])
    fresh = np.ones(n, bool)
    fresh[1:] = (seen[starts[1:]] != seen[stops[:-1]]) | (doc[1:] != doc[:-1])
    unit = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    past = np.append(first[1:], n)
    text_of = _prints((word + 1).astype(np.uint64) * salt[word % 0x110000], first, past)
    key = pd.factorize(pd.MultiIndex.from_arrays([doc[first], text_of, past - first]))[0] if len(first) else np.zeros(0, np.int64)
    earliest = np.zeros(len(first), bool)
    earliest[np.unique(key, return_index=True)[1]] = True
    cover |= ~earliest[unit]
    # two rounds of doubling over all; documents without a repeated string of four words leave here,
    # with the longest of one to three words that they repeat
    four, two = own, own
    longest[doc[_again(own)]] = 1
    for size in (1, 2):
        nxt = np.full(n, -1, np.int64)
        if size < n:
            same = doc[:-size] == doc[size:]
            nxt[:-size][same] = four[size:][same]
        # a string cut off by the document's end is told apart by its place
        two, four = four, pd.factorize(np.where(nxt < 0, -1 - np.arange(n), four * (n + 1) + nxt))[0].astype(np.int64)
    longest[doc[_again(two)]] = 2
    if n > 2:
        whole = doc[2:] == doc[:-2]
        three = np.where(whole, two[:-2] * (n + 1) + own[2:], -1 - np.arange(n - 2))
        longest[doc[:-2][_again(pd.factorize(three)[0])]] = 3
    stay = np.zeros(m, bool)
    stay[doc[_again(four)]] = True
    if stay.any():
        at = np.flatnonzero(stay[doc])
        sub = doc[at]
        levels, rank = _suffix_rounds(_classes(own[at]), sub)
        order = np.argsort(rank, kind="stable")
        lcp = np.zeros(len(at), np.int64)
        lcp[1:] = _common(levels, order[:-1], order[1:], sub)
        need = _passage(single[at], sub)
        fits = need[order] > 0
        head = np.ones(len(at), bool)
        head[1:] = (lcp[1:] < need[order][1:]) | ~fits[1:]
        group = np.cumsum(head) - 1
        earliest_at = np.minimum.reduceat(order, np.flatnonzero(head))
        later = order[(order != earliest_at[group]) & fits]
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, later, 1)
        np.add.at(mark, later + need[later], -1)
        cover[at] |= np.cumsum(mark)[:-1] > 0
        np.maximum.at(longest, sub[order], lcp)
    covered += np.bincount(doc[cover], weight[cover], m).astype(np.int64)
    return chars, covered, longest


def _passage(single: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many words from each place make a passage; 0 where the document ends before."""
    n = len(single)
    total = np.concatenate([[0], np.cumsum(np.where(single, 1, 2))])
    stop = np.searchsorted(total, total[:-1] + PASSAGE)
    last = np.searchsorted(doc, doc, side="right")
    return np.where(stop <= last, stop - np.arange(n), 0)


def document_repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, covered_chars, share, longest_repeat) of every row.

    ``n_chars`` counts characters of words only.  Null, empty and blank texts
    have share 0; a repeated row is measured again.  One pass, no shuffle.
    """

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts, part, size = [], [], 0
            for t in texts:
                if part and size + len(t) > CHUNK:
                    parts.append(part)
                    part, size = [], 0
                part.append(t)
                size += len(t) + 1
            parts.append(part)
            chars, covered, longest = (np.concatenate(x) for x in zip(*map(repeated, parts)))
            share = np.divide(covered, chars, out=np.zeros(len(chars)), where=chars > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chars), pa.array(covered), pa.array(share), pa.array(longest)],
                names=["doc_id", "n_chars", "covered_chars", "share", "longest_repeat"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(
        run, f"doc_id {kind}, n_chars long, covered_chars long, share double, longest_repeat long"
    )
