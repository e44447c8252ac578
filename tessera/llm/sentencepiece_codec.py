"""SentencePiece encoding and decoding, with giant documents as a max-plus parallel scan.

The model's pieces are byte-pair merges. A token sequence is the encoding of its text just when each neighbouring
pair of tokens is the encoding of the pair's own text, so encoding is a best path in a lattice whose edges weigh
0 (the pair fits) or minus infinity, and there is one path of weight 0. That makes it a max-plus product:

* a text is cut into units that no piece crosses (a piece never has a space mark after another character); the
  lattice between units is a single state, and units are encoded by the library and remembered;
* a document above GIANT characters becomes chunks. A chunk's boundary state is the token that covers or ends at
  its edge; at a unit's edge there is only the free state. Each chunk yields its transfer matrix from states to
  states (sparse: the pairs of weight 0). Matrices are combined associatively: products of GROUP chunks each in
  parallel tasks, then over a document's groups, then down again to the states at every chunk's edges; and every
  chunk is read back on its own between two states.

Ids equal the library's encode(text). Results for odd input: null text is empty, with no ids; spaces and line
breaks are kept; characters outside the vocabulary become byte pieces; a text that holds U+2581 itself decodes to
spaces there, as the library does; repeated rows give a row each; an empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns, texts
from tessera.session import materialize

MARK = "▁"
#: Documents of more characters are chunked, into about CHUNK characters each.
GIANT = 1 << 16
CHUNK = 1 << 15
#: How far back from a chunk's end a unit's edge is looked for.
REACH = 1 << 12
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
FREE = (0, 0)
State = tuple[int, int]


class Codec:
    """A model file with its tables; one for each Python worker."""

    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=path)
        n = self.lib.vocab_size()
        self.piece_bytes = []
        self.rank: dict[str, tuple[float, int]] = {}
        byte = {}
        for i in range(n):
            piece = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.lib.is_control(i) or self.lib.is_unknown(i):
                self.piece_bytes.append(b"")
            else:
                self.rank[piece] = (self.lib.get_score(i), i)
                self.piece_bytes.append(piece.replace(MARK, " ").encode())
        self.byte = byte
        self.longest = max(map(len, self.rank))
        self.units = _Units(self)
        self.most = most
        self.fits: dict[tuple[str, str], bool] = {}

    def ids_of(self, token: str) -> list[int]:
        """A piece's id, or the bytes of a character outside the vocabulary."""
        if token in self.rank:
            return [self.rank[token][1]]
        return [self.byte[b] for b in token.encode()]

    def merges(self, text: str) -> list[str]:
        """Tokens of a short string by merging the best pair, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                got = self.rank.get(parts[k] + parts[k + 1])
                if got and (best is None or got[0] > best[0]):
                    best = (got[0], k)
            if best is None:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > self.most:
                self.fits.clear()
            self.fits[key] = self.merges(a + b) == [a, b]
        return self.fits[key]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, unit by unit."""
        if not text:
            return np.zeros(0, "<i4")
        if len(self.units) > self.most:
            self.units.clear()
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            units = _UNIT.findall(MARK + text.replace(" ", MARK))
        else:
            units = [MARK + w for w in text.split(" ")]
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    # -- chunks: text is left + own + right, of which own is the chunk's part

    def tokens_ending(self, text: str, p: int) -> Iterator[int]:
        """Starts of the tokens that may end at p."""
        for q in range(p - 1, max(-1, p - 1 - self.longest), -1):
            if q == p - 1 or text[q:p] in self.rank:
                yield q

    def walk(self, text: str, a: int, b: int, start: State, stop: int) -> dict[int, int]:
        """From state start at a: for each end that is reached up to stop, where its token starts."""
        first = a + start[1]
        came: dict[int, int] = {first: a - start[0] if start != FREE else first}
        for p in range(first + 1, stop + 1):
            for q in self.tokens_ending(text, p):
                if q < b and q in came and (came[q] == q or self.fit(text[came[q]:q], text[q:p])):
                    came[p] = q
                    break
        return came

    def states(self, text: str, at: int) -> list[State]:
        """Tokens that cover or end at a place inside a unit, as (characters before it, characters after it)."""
        return [(at - q, p - at) for p in range(at, min(len(text), at + self.longest - 1) + 1) for q in self.tokens_ending(text, p) if q < at]

    def transfer(self, left: str, own: str, right: str, free_in: bool, free_out: bool) -> list[tuple[State, State]]:
        if free_in and free_out:
            return [(FREE, FREE)]
        text, a = left + own + right, len(left)
        b = a + len(own)
        out = []
        for s in [FREE] if free_in else self.states(text, a):
            came = self.walk(text, a, b, s, b if free_out else min(len(text), b + self.longest - 1))
            if free_out:
                out += [(s, FREE)] if b in came else []
            else:
                out += [(s, (b - q, p - b)) for p, q in came.items() if p >= b > q]
        return out

    def read_back(self, left: str, own: str, right: str, start: State, stop: State) -> list[int]:
        """Ids of the tokens that begin in the chunk's part between two states."""
        if start == stop == FREE:
            return np.frombuffer(b"".join(map(self.units.__getitem__, _UNIT.findall(own))), "<i4").tolist()
        text, a = left + own + right, len(left)
        b = a + len(own)
        end = b + stop[1]
        came = self.walk(text, a, b, start, end)
        tokens, p = [], end
        while p > a + start[1]:
            tokens.append(text[came[p]:p])
            p = came[p]
        return [i for t in reversed(tokens) for i in self.ids_of(t)]


class _Units(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        c = self.codec
        ids = c.lib.encode(unit[1:].replace(MARK, " ")) if len(unit) > 1 else c.ids_of(unit)
        value = self[unit] = np.array(ids, "<i4").tobytes()
        return value


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cut(text: str, size: int = CHUNK, longest: int = 16) -> list[tuple[str, str, str, bool, bool]]:
    """A text with its marks as (left, own, right, free at its start, free at its end)."""
    out, at, free = [], 0, True
    while at < len(text):
        end = min(len(text), at + size)
        free_out = end == len(text)
        if not free_out:
            for k in range(end, max(at + 1, end - REACH), -1):
                if text[k] == MARK and text[k - 1] != MARK:
                    end, free_out = k, True
                    break
        out.append(("" if free else text[max(0, at - longest):at], text[at:end], "" if free_out else text[end:end + longest], free, free_out))
        at, free = end, free_out
    return out


def combine(a: set[tuple[State, State]], b: set[tuple[State, State]]) -> set[tuple[State, State]]:
    """The max-plus product of two transfer matrices, each given by its entries of weight 0."""
    after: dict[State, list[State]] = {}
    for s, t in b:
        after.setdefault(s, []).append(t)
    return {(s, u) for s, t in a for u in after.get(t, ())}


def product(matrices: list[set[tuple[State, State]]]) -> set[tuple[State, State]]:
    """The product of neighbouring matrices, in pairs, level by level."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k:k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def scan(matrices: list[set[tuple[State, State]]], start: State = FREE, stop: State = FREE) -> list[tuple[State, State]]:
    """The states before and after each matrix on the path of weight 0 from start to stop."""
    if len(matrices) == 1:
        return [(start, stop)]
    half = len(matrices) // 2
    left, right = matrices[:half], matrices[half:]
    after = {s for s, t in product(right) if t == stop}
    middle = min(t for s, t in product(left) if s == start and t in after)
    return scan(left, start, middle) + scan(right, middle, stop)


_CHUNKS = "sha string, k int, left string, own string, right string, free_in boolean, free_out boolean"
_STATE = "s0 int, s1 int, t0 int, t1 int"
#: Chunks whose product is one task's; a document has at most as many of these groups as 2 GB of text give.
GROUP = 64


def _giants(giant: DataFrame, model: str, chunk: int) -> DataFrame:
    """sha, ids of the distinct giant texts."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = codec(model).longest
        for b in batches:
            for sha, text in zip(*columns(b, "sha", "text"), strict=True):
                parts = cut(MARK + text.replace(" ", MARK), chunk, longest)
                for lo in range(0, len(parts), 64):
                    some = parts[lo:lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([sha] * len(some)), pa.array(range(lo, lo + len(some)), pa.int32()), *map(pa.array, zip(*some, strict=True))],
                                                     ["sha", "k", "left", "own", "right", "free_in", "free_out"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            rows = [(sha, k, *s, *t) for sha, k, *parts in zip(*columns(b, "sha", "k", "left", "own", "right", "free_in", "free_out"), strict=True) for s, t in c.transfer(*parts)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(x, pa.int32()) for x in cols[1:])], ["sha", "k", "s0", "s1", "t0", "t1"])

    def matrices(pdf: pd.DataFrame, by: str) -> tuple[list[int], list[set]]:
        got = [(int(k), {((r.s0, r.s1), (r.t0, r.t1)) for r in g.itertuples()}) for k, g in pdf.groupby(by, sort=True)]
        return [k for k, _ in got], [m for _, m in got]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        found = product(matrices(pdf, "k")[1])
        return pd.DataFrame([(pdf["sha"].iloc[0], pdf["g"].iloc[0], *s, *t) for s, t in sorted(found)], columns=["sha", "g", "s0", "s1", "t0", "t1"])

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        gs, ms = matrices(pdf, "g")
        return pd.DataFrame([(pdf["sha"].iloc[0], g, *s, *t) for g, (s, t) in zip(gs, scan(ms), strict=True)], columns=["sha", "g", "a0", "a1", "b0", "b1"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        ks, ms = matrices(pdf, "k")
        r = pdf.iloc[0]
        path = scan(ms, (int(r["a0"]), int(r["a1"])), (int(r["b0"]), int(r["b1"])))
        return pd.DataFrame([(r["sha"], k, *s, *t) for k, (s, t) in zip(ks, path, strict=True)], columns=["sha", "k", "s0", "s1", "t0", "t1"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            sha, k, left, own, right, *s = columns(b, "sha", "k", "left", "own", "right", "s0", "s1", "t0", "t1")
            ids = [c.read_back(x, y, z, (p, q), (u, v)) for x, y, z, p, q, u, v in zip(left, own, right, *s, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(k, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["sha", "k", "ids"])

    n = int(giant.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialize(giant.dropDuplicates(["sha"]).mapInArrow(split, _CHUNKS).repartition(n, "sha", "k"), "chunks")
    # Up: products of GROUP chunks each, in parallel. Over: a document's groups. Down: the states inside each group, in parallel.
    steps = materialize(chunks.mapInArrow(transfers, f"sha string, k int, {_STATE}").withColumn("g", (F.col("k") / GROUP).cast("int")), "transfers")
    groups = steps.groupBy("sha", "g").applyInPandas(products, f"sha string, g int, {_STATE}")
    ends = groups.groupBy("sha").applyInPandas(between, "sha string, g int, a0 int, a1 int, b0 int, b1 int")
    paths = steps.join(ends, ["sha", "g"]).groupBy("sha", "g").applyInPandas(inside, f"sha string, k int, {_STATE}")
    parts = chunks.join(paths, ["sha", "k"]).mapInArrow(read, "sha string, k int, ids array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("sha").agg(whole.alias("ids"))


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for every row. model: path of a byte-pair SentencePiece model, on every worker."""
    bounded_batches(docs.sparkSession)
    body = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids, text = columns(b, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c.encode(t) for t in text], pa.list_(pa.int32()))], ["doc_id", "ids"])

    plain = body.where(F.length("text") <= giant).mapInArrow(run, "doc_id long, ids array<int>")
    large = body.where(F.length("text") > giant).withColumn("sha", F.sha2("text", 256))
    return plain.unionByName(large.select("doc_id", "sha").join(_giants(large, model, chunk), "sha").select("doc_id", "ids"))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids give an empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x or [], np.int32)) for x in ids], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256 for rows of encode()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            flat = b.column(1).flatten().to_numpy().astype("<i4")
            cut_at = np.cumsum(b.column(1).value_lengths().to_numpy())[:-1]
            parts = np.split(flat, cut_at) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in parts], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in parts], pa.string())], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
