"""Order-preserving packing of documents into fixed-size training sequences by dynamic programming.

Every input partition is a stream of tokens in the order of its rows. Window cuts are chosen to minimise the
padding plus a penalty for each cut that truncates something: none after a document, little after a sentence,
more inside one (only every GRID tokens). f(j) = penalty(j) + min over i in [j - size, j) of f(i) + size - (j - i);
as the padding is linear in i, the minimum slides with a monotone queue. The stream's rest, shorter than a
sequence, is cut into powers of two, which need no padding. No shuffle and no state beyond a block of tokens, so
a lost task is simply packed again, to the same sequences.

Results for odd input: a null text is empty, and an empty document is its separator alone; documents longer than
a sequence go on in the next ones; of cuts that cost the same the earliest start wins; rows that repeat or have no doc_id are documents of their own; an empty table gives no rows.
Strings like "<|endoftext|>" in a text are added tokens with ids of their own where added is set, as for the
tokenizer by default, and ordinary text otherwise. Only id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, columns, texts

SIZE = 1024
SEPARATOR = 0
#: Tokens between cut points inside a sentence, and what cuts cost in tokens of padding.
GRID = 16
AFTER_SENTENCE, INSIDE = 2.0, 10.0
#: Tokens that are packed at once.
BLOCK = 1 << 18
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Fixed value: the split pattern that goes with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, by a cache of words: a space that is followed by a non-space always begins a new piece.

    Reads the vocabulary from the tokenizer's JSON file.
    """

    def __init__(self, path: str, most: int = 300_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {t: np.array([k], "<u4") for t, k in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}
        self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(*spec["model"]["vocab"].values(), *special.values()) + 1, bool)
        self.ends[[k for piece, k in ranks.items() if piece.rstrip()[-1:] in (b".", b"!", b"?") or piece.endswith(b"\n")]] = True
        self.most = most
        self.words = _Words(self)

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode_added(self, text: str) -> np.ndarray:
        """Like encode, but the added tokens in the text get their own ids."""
        parts = self.split(text)
        if len(parts) == 1:
            return self.encode(text)
        return np.concatenate([self.special[x] if k % 2 else self.encode(x) for k, x in enumerate(parts) if x])

    def encode(self, text: str) -> np.ndarray:
        if "  " in text:
            return np.array(self.bpe.encode_ordinary(text), "<u4")
        first, *rest = text.split(" ")
        if len(self.words) > self.most:
            self.words.clear()
        return np.frombuffer(self.plain(first) + b"".join(map(self.words.__getitem__, rest)), "<u4")


class _Words(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        value = self[word] = self.encoder.plain(" " + word)
        return value


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(ends: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with their penalties. ends, docs: positions after sentences and documents."""
    cost = np.full(n + 1, np.inf)
    cost[GRID::GRID] = INSIDE
    cost[ends] = AFTER_SENTENCE
    cost[docs] = 0.0
    cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost[1:])) + 1
    return at, cost[at]


def windows(at: np.ndarray, cost: np.ndarray, size: int = SIZE, free_last: bool = False) -> list[int]:
    """The ends of the windows of the cheapest cover of [0, at[-1]]; free_last: the last one's padding costs nothing."""
    queue = deque([(0, 0.0, 0)])  # position, f(position) + position, index: increasing in both
    back = [0] * (len(at) + 1)
    pos, value = [0, *at.tolist()], [0.0] * (len(at) + 1)
    for k, (j, c) in enumerate(zip(pos[1:], cost.tolist(), strict=True), 1):
        while queue[0][0] < j - size:
            queue.popleft()
        _, low, back[k] = queue[0]
        low += size + c  # f(j) + j
        value[k] = low - j
        while queue and queue[-1][1] > low:
            queue.pop()
        queue.append((j, low, k))
    if free_last:
        k = len(at) - 1
        while k >= 0 and pos[k] >= pos[-1] - size:
            if value[k] <= value[back[-1]]:
                back[-1] = k
            k -= 1
    out = []
    k = len(at)
    while k:
        out.append(pos[k])
        k = back[k]
    return out[::-1]


class Packer:
    """Takes documents one after the other and gives rows of pieces."""

    def __init__(self, tokens: Encoder, first_sequence: int, size: int = SIZE, added: bool = False):
        self.ids_of = tokens.encode_added if added else tokens.encode
        self.tokens, self.sequence, self.size = tokens, first_sequence, size
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # doc_id, tokens of it before the block, tokens of it in the block
        self.totals: list[int] = []
        self.n = 0

    def add(self, doc_id: int, text: str) -> list[tuple]:
        ids = np.append(self.ids_of(text), np.uint32(SEPARATOR))
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.totals.append(len(ids))
        self.n += len(ids)
        return self.pack(False) if self.n >= BLOCK else []

    def pack(self, final: bool) -> list[tuple]:
        if not self.n:
            return []
        ids = np.concatenate(self.ids)
        cuts = np.cumsum([d[2] for d in self.docs])
        done = cuts if final else cuts[:-1]
        at, cost = cut_points(np.flatnonzero(self.tokens.ends[ids]) + 1, done, self.n)
        ends = windows(at, cost, self.size, free_last=True)
        if final:
            begin = ends[-2] if len(ends) > 1 else 0
            left = self.n - begin
            if left & (left - 1) and left != self.size:
                ends.pop()
                for bit in reversed(range(left.bit_length())):
                    if left >> bit & 1:
                        begin += 1 << bit
                        ends.append(begin)
        else:
            ends = ends[:-1]  # the last window waits for what follows
        rows = self.rows(ids, ends)
        used = ends[-1] if ends else 0
        keep_docs, keep_totals, pos = [], [], 0
        for (doc, before, n), total in zip(self.docs, self.totals, strict=True):
            if pos + n > used:
                gone = max(0, used - pos)
                keep_docs.append((doc, before + gone, n - gone))
                keep_totals.append(total)
            pos += n
        self.docs, self.totals, self.ids, self.n = keep_docs, keep_totals, [ids[used:]], self.n - used
        return rows

    def rows(self, ids: np.ndarray, ends: list[int]) -> list[tuple]:
        out = []
        d, doc_at = 0, 0
        begin = 0
        raw = memoryview(ids.tobytes())
        for end in ends:
            pos = begin
            while pos < end:
                doc, before, n = self.docs[d]
                stop = min(end, doc_at + n)
                out.append((doc, before + pos - doc_at, stop - pos, zlib.crc32(raw[4 * pos:4 * stop]), self.totals[d], self.sequence, pos - begin))
                pos = stop
                if pos == doc_at + n:
                    doc_at += n
                    d += 1
            begin = end
            self.sequence += 1
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = np.array([r[1:] for r in rows], np.int64).reshape(len(rows), len(names) - 1).T
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """A row for each piece of a document, see SCHEMA. tokenizer: path of the byte-level BPE's JSON file, on every worker.

    added: added tokens in a text get their own ids, as the tokenizer gives them by default.

    sequence_id: the partition in the high bits, the sequence's number in the partition in the low 40.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(encoder(tokenizer), TaskContext.get().partitionId() << 40, size, added)
        for b in batches:
            rows = []
            for doc_id, text in zip(*columns(b, "doc_id", "text"), strict=True):
                rows += packer.add(doc_id, text)
            if rows:
                yield _batch(rows)
        if rows := packer.pack(True):
            yield _batch(rows)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
