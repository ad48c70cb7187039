"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 8).

The merges are compiled, rank by rank, into a deterministic automaton.  Its
states are the last emitted token.  The gadget of the merge ``(u, v) -> w`` adds
arc ``w`` and makes ``v`` unreachable right after ``u`` wherever that merge
would have been applied; what remains are exactly the token strings that BPE
emits, and each byte string has one path.  Encoding a word walks the arcs whose
labels spell it; decoding emits the arc labels.

Arcs are decided from the gadgets on first use and kept.  Texts are split into
words with array operations over a whole Arrow batch, words are looked up by a
64-bit fingerprint, and only words not yet met are walked, so nothing runs per
character or per word in Python.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words at least this long aren't kept by fingerprint but walked each time.
LONG_WORD = 512
#: Characters handled at once; longer batches are cut between documents.
CHUNK = 1 << 20
#: Kept words of one Python worker; beyond it the table starts anew.
KEPT_WORDS = 400_000
#: Kept decisions on arcs of one Python worker; beyond it the table starts anew.
KEPT_ARCS = 1_000_000

LETTER, NUMBER, OTHER, SPACE, EDGE = 1, 2, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeAutomaton:
    """Deterministic automaton over tokens; see the module."""

    def __init__(self, ranks: dict[bytes, int]):
        self.label = {r: b for b, r in ranks.items()}
        self.arcs: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.lengths: dict[int, list[int]] = {}
        self._allowed: dict[tuple[int, int], bool] = {}
        for b, r in ranks.items():
            if len(b) == 1:
                self._arc(b, r)
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                self._gadget(b, r)
        self._allowed.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_allowed"}

    def __setstate__(self, state):
        self.__dict__ = state | {"_allowed": {}}

    def _arc(self, b: bytes, r: int) -> None:
        self.arcs[b] = r
        sizes = self.lengths.setdefault(b[0] << 8 | b[1] if len(b) > 1 else b[0] - 256, [])
        if len(b) not in sizes:
            sizes.append(len(b))
            sizes.sort(reverse=True)

    def _gadget(self, b: bytes, r: int) -> None:
        """Add the merge that makes ``b`` from the two tokens it has been so far."""
        pair = self.walk(b)
        if len(pair) == 2:
            self.parts[r] = (pair[0], pair[1])
            self.merged[pair[0], pair[1]] = r
            self._allowed.pop((pair[0], pair[1]), None)
        self._arc(b, r)

    def allowed(self, a: int, b: int) -> bool:
        """Is there an arc ``b`` after ``a``: no merge crosses the seam while both its parts are alive."""
        known = self._allowed.get((a, b))
        if known is None:
            if len(self._allowed) > KEPT_ARCS:
                self._allowed.clear()
            known = self._allowed[a, b] = self._open(a, b)
        return known

    def _open(self, a: int, b: int) -> bool:
        left, dies = a, 1 << 30
        while True:
            right, ends = b, 1 << 30
            while True:
                w = self.merged.get((left, right))
                # of equal ranks the left merge goes first
                if w is not None and w < dies and w <= ends:
                    return False
                if right not in self.parts:
                    break
                right, ends = self.parts[right][0], right
            if left not in self.parts:
                return True
            left, dies = self.parts[left][1], left

    def walk(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells ``word``."""
        whole = self.arcs.get(word)
        if whole is not None:
            return [whole]
        n, arcs, lengths = len(word), self.arcs, self.lengths
        path: list[int] = []
        at, dead, limit = 0, set(), n + 1
        while at < n:
            step = 0
            two = lengths.get(word[at] << 8 | word[at + 1], ()) if at + 1 < n else ()
            for size in (*two, 1):
                if size >= limit or at + size > n or at + size in dead:
                    continue
                t = arcs.get(word[at : at + size])
                if t is not None and (not path or self.allowed(path[-1], t)):
                    step = size
                    break
            if step:
                path.append(t)
                at += step
                limit = n + 1
            else:  # nothing continues: the last arc was too long
                dead.add(at)
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                limit = len(self.label[path.pop()])
                at -= limit
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.label[i] for i in ids)


def _classes() -> np.ndarray:
    """The class of every code point; surrogates can't occur in a text."""
    table = np.full(0x110000, OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(lo, hi)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, chars):
                table[lo + m.start() : lo + m.end()] = kind
    return table


class WordTables:
    """Tables of a Python worker: character classes, fingerprint powers, kept words."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.kind = _classes()
        rng = np.random.default_rng(7)
        self.salt = rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        self._grow(CHUNK * 2)
        self._forget()

    def _grow(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, base, np.uint64))
            self.back = np.cumprod(np.full(n, inverse, np.uint64))

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids, self.filled = np.zeros(1 << 18, np.int32), 0

    def _keep(self, ids: list[int]) -> int:
        if self.used == len(self.start):
            self.start, self.count = np.resize(self.start, 2 * self.used), np.resize(self.count, 2 * self.used)
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[self.used], self.count[self.used] = self.filled, len(ids)
        self.used, self.filled = self.used + 1, self.filled + len(ids)
        return self.used - 1

    def words(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where words start; ``kind`` has EDGE after each document, which is a word of its own."""
        n = len(cp)
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        edge = kind == EDGE
        begins |= edge
        space = kind == SPACE
        # the last blank before a word or number is split off; a plain space goes to what follows
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:])
        begins[last] = True
        begins[last[cp[last] == 32] + 1] = False
        quote = np.flatnonzero((cp == 39) & begins)
        quote = quote[quote + 3 < n + 1]
        if len(quote):
            pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
            kpad = np.concatenate([kind, np.full(3, EDGE, kind.dtype)])
            one, two = pad[quote + 1], pad[quote + 2]
            one = np.where(kpad[quote + 1] == EDGE, 0, one)
            two = np.where((kpad[quote + 2] == EDGE) | (one == 0), 0, two)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (
                ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            )
            for which, size in ((short, 2), (long, 3)):
                q = quote[which]
                begins[q + 1] = False
                begins[np.minimum(q + size, n - 1)] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts and where each text's ids end."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends_at = np.cumsum(sizes + 1) - 1
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[cp]
        kind[ends_at] = EDGE
        starts = self.words(cp, kind)
        stops = np.append(starts[1:], len(cp))
        if len(cp) > len(self.power):
            self._grow(2 * len(cp))
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.salt[cp] * self.power[: len(cp)], out=total[1:])
            prints = (total[stops] - total[starts]) * self.back[starts]
        real = kind[starts] != EDGE
        prints[~real] = 0
        long = real & (stops - starts >= LONG_WORD)
        # a long word gets a number of its own
        prints[long] = np.flatnonzero(long).astype(np.uint64) + np.uint64(1)
        codes, unique = pd.factorize(prints)
        if len(self.known) > KEPT_WORDS:
            self._forget()
        where = np.empty(len(unique), np.int64)
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        known, walk = self.known, self.automaton.walk
        none = self._keep([])
        for i, p in enumerate(unique.tolist()):
            k = first[i]
            if not real[k]:
                where[i] = none
                continue
            at = None if long[k] else known.get(p)
            if at is None:
                at = self._keep(walk(joined[starts[k] : stops[k]].encode()))
                if not long[k]:
                    known[p] = at
            where[i] = at
        spot = where[codes]
        count = self.count[spot]
        ends = np.cumsum(count)
        flat = np.repeat(self.start[spot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[flat], ends[~real]


_tables: dict[int, WordTables] = {}


def _worker_tables(shared) -> WordTables:
    key = id(shared)
    if key not in _tables:
        _tables.clear()
        _tables[key] = WordTables(shared.value)
    return _tables[key]


def _cut(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def encode_texts(tables: WordTables, column) -> tuple[np.ndarray, np.ndarray]:
    """ids and end offsets of an Arrow text column; null counts as empty."""
    texts = [t or "" for t in column.to_pylist()]
    ids, ends, base = [], [], 0
    for part in _cut(texts):
        i, e = tables.encode(part)
        ids.append(i)
        ends.append(e + base)
        base += len(i)
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(np.int32), *ids]), np.concatenate([none, *ends])


def _broadcast(df: DataFrame, vocabulary: str):
    """The compiled automaton: as large as the vocabulary, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(MergeAutomaton(read_ranks(vocabulary)))


def token_ids(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each text without special tokens.

    Null and empty texts give an empty list, repeated rows give repeated rows,
    and special-token strings in a text are ordinary text.  One pass, no shuffle.
    """
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        tables = _worker_tables(shared)
        for b in batches:
            ids, ends = encode_texts(tables, b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row."""
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        tables = _worker_tables(shared)
        for b in batches:
            _, ends = encode_texts(tables, b.column(b.num_columns - 1))
            n = pa.array(np.diff(np.append(0, ends)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return spread(rows).mapInArrow(run, f"{schema}, n_tokens long")


def decoded(ids: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text): the arc labels of each id list, joined; a null list gives a null text.

    Labels are taken and joined as whole columns; bytes that are no UTF-8, which
    ids of texts never give, become replacement characters.
    """
    shared = _broadcast(ids, vocabulary)

    def run(batches):
        labels = shared.value.label
        arcs = pa.array([labels.get(i) for i in range(max(labels) + 1)], pa.large_binary())
        for b in batches:
            lists = b.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            # the labels lie one after another: a text is a slice of them
            spelled = arcs.take(lists.flatten()) if len(lists) else arcs[:0]
            at = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1) if len(spelled) else np.zeros(1, np.int64)
            bounds = at[np.append(0, np.cumsum(counts)).astype(np.int64)]
            data = spelled.buffers()[2] if len(spelled) else pa.py_buffer(b"")
            joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.tobytes()), data])
            joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.large_binary()))
            try:
                texts = joined.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
