"""Alignment of two tokenizers' tokens by the elementary intervals of their byte ends.

The ends of A's tokens and of B's tokens, united (numpy's union1d), cut the text into elementary intervals; searchsorted
gives each interval's owner in A and in B, so an interval is one overlap. An end that both have closes a group, and a
group's links are all pairs of its A tokens and its B tokens.

A single space between two other characters begins a new token for both kinds of tokenizer, so such a place is a shared
end whatever stands around it: the intervals of a text are those of its units, the stretches between these places. A
task aligns each different unit of a block once, and a document is its units' groups in order. (A unit can be a whole
text: one without spaces, say.)

Corpus counts. A block is BLOCK characters of whole documents (one at least). It becomes some rows: its documents' units,
its units' pairs and, for each different pair of ids, how many of its documents hold it linked. Those dictionaries are
exploded and summed by pair, joined back by pair, and met by block again (a cogroup), so the second pass meets a
dictionary of its own block and never the corpus's. The highest count of each A id is broadcast: a row for each id of A's vocabulary.

Results for odd input: texts that are null, empty or not given back by the joined bytes of either tokenizer (as with
U+2581 in them) have no tokens; special tokens in a text are plain text; rows that repeat are documents of their own and
count each; a null doc_id is kept as null; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns, texts
from tessera.llm.packing import Encoder
from tessera.llm.packing import encoder as byte_encoder
from tessera.llm.sentencepiece_codec import MARK, Codec
from tessera.llm.sentencepiece_codec import codec as piece_codec
from tessera.session import materialize

#: Characters of a block's documents, characters of units that are aligned at once, links that are expanded at once, and characters that are encoded at once.
BLOCK = 1 << 21
SLICE = 1 << 17
STRETCH = 20_000
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Some rows for each block, none of them large: parts of its units (with the dictionary in the first one), then of its
#: documents. Integers are the deflated bytes of numpy arrays, see RAW; the dictionary's are arrays, to be exploded.
BLOCKS = (
    "block long, part int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
    "doc_n binary, unit binary, times binary, unit_n binary, pair binary, multiple binary, a array<int>, b array<int>, docs array<int>")
KEPT = [c.split()[0] for c in BLOCKS.split(", ") if c.split()[0] not in ("a", "b", "docs")]
RAW = {"doc_n": "<i4", "unit": "<i4", "times": "<i4", "unit_n": "<i4", "pair": "<i4", "multiple": "<i8"}
#: Entries of a row.
PART = 1 << 14
GROUPS = "doc_id long, groups array<struct<first:long,past:long,a:array<int>,b:array<int>>>"
#: Places where a unit may begin: single spaces between other characters. ODD: the text has spaces of another kind.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"  |\s \s|^ | $")


def units_of(text: str) -> list[str]:
    return _BORDER.split(text) if _ODD.search(text) else text.split(" ")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals' ends with their owners among A's and B's tokens: one overlap each. Both ends are ascending."""
    cuts = np.union1d(ends_a, ends_b)
    return cuts, np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def closed(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of A tokens and of B tokens up to its end: an interval that ends both its owners closes one."""
    cuts, own_a, own_b = intervals(ends_a, ends_b)
    shared = (ends_a[own_a] == cuts) & (ends_b[own_b] == cuts)
    return own_a[shared] + 1, own_b[shared] + 1


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of each of counts.sum() items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links) of the groups' products; owner: each group's unit; pair: A's id in the high 32 bits.

    A group whose product is larger than a slice is multiplied by its different ids.
    """
    n_a, n_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    first_a, first_b = group_a - n_a, group_b - n_b
    links = n_a * n_b
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    large = links > SLICE
    for g in np.flatnonzero(large):
        a, ca = np.unique(ids_a[first_a[g]:group_a[g]], return_counts=True)
        b, cb = np.unique(ids_b[first_b[g]:group_b[g]], return_counts=True)
        pair = (a.astype(np.int64)[:, None] << 32 | b.astype(np.int64)[None, :]).ravel()
        out.append((np.full(len(pair), owner[g]), pair, np.outer(ca, cb).ravel()))
    small = np.flatnonzero(~large)
    at = np.searchsorted(np.cumsum(links[small]), np.arange(0, int(links[small].sum()), SLICE))
    for low, high in zip(at, [*at[1:], len(small)], strict=True):
        g = small[low:high]
        k, within = _spread(links[g])
        g = g[k]
        pair = ids_a[first_a[g] + within // n_b[g]].astype(np.int64) << 32 | ids_b[first_b[g] + within % n_b[g]].astype(np.int64)
        out.append((owner[g], pair, np.ones(len(g), np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    own, pair, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((pair, own))
    own, pair, n = own[order], pair[order], n[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])])
    return own[new], pair[new], np.add.reduceat(n, new)


class Tables:
    """Both tokenizers with their tokens' byte lengths; one for each Python worker."""

    def __init__(self, a: Encoder, b: Codec):
        self.a, self.b = a, b
        self.length_a = np.zeros(len(a.ends), np.int64)
        for raw, k in a.bpe._mergeable_ranks.items():
            self.length_a[k] = len(raw)
        self.length_b = np.array([len(x) for x in b.piece_bytes], np.int64)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's ids of space+text and B's of text; None if the bytes of either differ from space+text."""
        want = (" " + text).encode()
        a, b = np.array(self.a.bpe.encode_ordinary(" " + text), np.int64), np.array(self.b.lib.encode(text), np.int64)
        if int(self.length_a[a].sum()) != len(want) or b"".join(map(self.b.piece_bytes.__getitem__, b.tolist())) != want:
            return None
        return a, b

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids of A and B of all units in a row, how many there are up to each unit's end, and which units are given back.

        Units without white space at their ends are joined by single spaces and encoded together, STRETCH characters at a time.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        ok: list[bool] = []
        past = itertools.accumulate(len(u) + 1 for u in units)
        for (whole, _), run in itertools.groupby(units, lambda u: (u == u.strip(), next(past) // STRETCH)):
            run = list(run)
            got = self.ids(" ".join(run)) if whole else None
            if got is not None:
                ends = np.cumsum([len(u.encode()) + 1 for u in run])
                found.append((*got, *(np.searchsorted(np.cumsum(n[x]), ends) + 1 for n, x in zip((self.length_a, self.length_b), got, strict=True))))
                ok += [True] * len(run)
                continue
            for u in run:
                got = self.ids(u)
                ok.append(got is not None)
                x, y = got or (np.zeros(0, np.int64),) * 2
                found.append((x, y, np.array([len(x)]), np.array([len(y)])))
        ids_a, ids_b, past_a, past_b = zip(*found, strict=True)
        before_a, before_b = (np.cumsum([0, *map(len, x)]) for x in (ids_a, ids_b))
        return (np.concatenate(ids_a), np.concatenate(ids_b), np.concatenate([p + k for p, k in zip(past_a, before_a, strict=False)]),
                np.concatenate([p + k for p, k in zip(past_b, before_b, strict=False)]), ok)


_tables: dict[tuple[str, str], Tables] = {}


def tables(a: str, b: str) -> Tables:
    if (a, b) not in _tables:
        _tables[a, b] = Tables(byte_encoder(a), piece_codec(b))
    return _tables[a, b]


class Units:
    """The different units of some texts, aligned slice by slice."""

    def __init__(self, of: Tables):
        self.of = of
        self.known: dict[str, int] = {}
        self.ok: list[bool] = []
        self.text: list[str] = []  # a unit's groups as the digest writes them
        self.counts: list[np.ndarray] = [np.zeros((0, 4), np.int64)]  # tokens of A, of B, groups, links
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[str] = []
        self.size = 0

    def number(self, unit: str) -> int:
        k = self.known.get(unit)
        if k is None:
            k = self.known[unit] = len(self.known)
            self.waiting.append(unit)
            self.size += len(unit) + 1
            if self.size >= SLICE:
                self.align()
        return k

    def align(self) -> None:
        if not self.waiting:
            return
        first = len(self.text)
        ids_a, ids_b, past_a, past_b, ok = self.of.units(self.waiting)
        group_a, group_b = closed(np.cumsum(self.of.length_a[ids_a]), np.cumsum(self.of.length_b[ids_b]))
        # A unit's end is an end of both, so its last group is the one that closes there.
        past = np.searchsorted(group_a, past_a, "right")
        n_groups = np.diff(past, prepend=0)
        n_a, n_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        links = np.diff(np.r_[0, np.cumsum(n_a * n_b)][past], prepend=0)
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        written, x, y = [], 0, 0
        for p, q in zip(group_a.tolist(), group_b.tolist(), strict=True):
            written.append(f"{a[x]}|{b[y]}" if p - x == q - y == 1 else ",".join(a[x:p]) + "|" + ",".join(b[y:q]))
            x, y = p, q
        low = 0
        for high in past.tolist():
            self.text.append(written[low] if high - low == 1 else ";".join(written[low:high]))
            low = high
        self.ok += ok
        self.counts.append(np.stack([np.diff(past_a, prepend=0), np.diff(past_b, prepend=0), n_groups, links], axis=1))
        own, pair, n = linked(ids_a, ids_b, group_a, group_b, np.repeat(np.arange(len(past)), n_groups))
        self.pairs.append((own + first, pair, n))
        self.waiting, self.size = [], 0


def _parts(n: np.ndarray, entries: int = PART) -> np.ndarray:
    """Where to cut items of so many entries each into parts of about so many entries; one part at least."""
    upto = np.cumsum(n + 1)
    cuts = np.searchsorted(upto, np.arange(entries, upto[-1] if len(n) else 0, entries)) + 1
    return np.unique(np.r_[0, cuts[cuts < len(n)], len(n)]) if len(n) else np.array([0, 0])


class Block:
    """Documents of one partition, up to BLOCK characters, as rows of BLOCKS."""

    def __init__(self, number: int, of: Tables):
        self.number, self.units = number, Units(of)
        self.ids: list[int | None] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.ids.append(doc_id)
        self.size += len(text)
        at: list[int] = []
        if text and MARK not in text:
            known, number = self.units.known, self.units.number
            at = [known[u] if u in known else number(u) for u in units_of(text)]
        self.docs.append(np.array(at, np.int32))

    def rows(self) -> pa.RecordBatch:
        u = self.units
        u.align()
        sums = np.concatenate(u.counts)
        totals, shas, unit, times = [], [], [], []
        broken = not all(u.ok)
        for at in self.docs:
            if broken and not all(map(u.ok.__getitem__, at.tolist())):
                at = at[:0]
            totals.append(sums[at].sum(axis=0))
            shas.append(hashlib.sha256(";".join(map(u.text.__getitem__, at.tolist())).encode()).hexdigest() if len(at) else "")
            k, n = np.unique(at, return_counts=True)
            unit.append(k)
            times.append(n)
        doc_n = np.array([len(k) for k in unit])
        unit, times = np.concatenate(unit), np.concatenate(times)
        own, pair, multiple = (np.concatenate(x) for x in zip(*u.pairs, strict=True)) if u.pairs else (np.zeros(0, np.int64),) * 3
        different, place = np.unique(pair, return_inverse=True)
        unit_n = np.bincount(own, minlength=len(u.text))
        holding = self.holding(np.r_[0, np.cumsum(doc_n)], unit, np.r_[0, np.cumsum(unit_n)], place, len(different))
        totals = np.array(totals, np.int64).reshape(-1, 4)
        # Rows: the units' parts have no documents, the documents' parts no units.
        units_to, docs_to = _parts(unit_n), _parts(doc_n)
        units_to, docs_to = np.r_[units_to, np.repeat(units_to[-1], len(docs_to) - 1)], np.r_[np.repeat(0, len(units_to) - 1), docs_to]
        rows = len(docs_to) - 1

        def pieces(x: np.ndarray, kind: str, to: np.ndarray) -> pa.Array:
            return pa.array([zlib.compress(x[p:q].astype(kind).tobytes(), 1) for p, q in zip(to, to[1:], strict=False)], pa.binary())

        def lists(x: pa.Array, to: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(to, pa.int32()), x)

        to = {"doc_n": docs_to, "unit_n": units_to} | {k: np.r_[0, np.cumsum(doc_n)][docs_to] for k in ("unit", "times")} | {k: np.r_[0, np.cumsum(unit_n)][units_to] for k in ("pair", "multiple")}
        raw = {"doc_n": doc_n, "unit": unit, "times": times, "unit_n": unit_n, "pair": place, "multiple": multiple}
        dictionary = np.r_[0, np.repeat(len(different), rows)]
        return pa.RecordBatch.from_arrays([
            pa.array([self.number] * rows, pa.int64()), pa.array(range(rows), pa.int32()), lists(pa.array(self.ids, pa.int64()), docs_to), *(lists(pa.array(totals[:, k]), docs_to) for k in range(4)),
            lists(pa.array(shas, pa.string()), docs_to), *(pieces(raw[k], kind, to[k]) for k, kind in RAW.items()),
            *(lists(pa.array(x.astype(np.int32)), dictionary) for x in (different >> 32, different & 0xFFFFFFFF, holding))], [c.split()[0] for c in BLOCKS.split(", ")])

    @staticmethod
    def holding(doc_at: np.ndarray, unit: np.ndarray, unit_at: np.ndarray, place: np.ndarray, pairs: int) -> np.ndarray:
        """How many documents of the block hold each pair, some documents at a time."""
        out = np.zeros(pairs, np.int64)
        n = np.diff(unit_at)[unit]
        upto = np.r_[0, np.cumsum(n)][doc_at]
        low = 0
        while low < len(doc_at) - 1:
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + SLICE, "right")) - 1)
            some = slice(doc_at[low], doc_at[high])
            k, within = _spread(n[some])
            doc = np.repeat(np.arange(low, high), np.diff(doc_at[low:high + 1]))[k]
            seen = np.unique(doc * max(1, pairs) + place[unit_at[unit[some]][k] + within])
            out += np.bincount(seen % max(1, pairs), minlength=pairs)
            low = high
        return out


def blocks_of(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Every block of docs, see BLOCKS. a: path of the byte-level BPE's JSON file, b: of the SentencePiece model, on every worker."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tables(a, b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number, of)
        for batch in batches:
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                block.add(doc_id, text)
                if block.size >= size:
                    yield block.rows()
                    number += 1
                    block = Block(number, of)
        if block.ids:
            yield block.rows()

    return texts(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold the pair of ids linked, and whether that is A's id's highest (best)."""
    counts = materialize(blocks.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).groupBy("p.a", "p.b").agg(F.sum(F.col("p.docs").cast("long")).alias("n")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(rows: pa.Table, seen: pa.Table) -> pa.Table:
    """DIGEST of a block's documents. rows: its parts; seen: n and best of its dictionary's pairs."""

    def summed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(x)][np.cumsum(n)], prepend=0)

    rows, seen = rows.sort_by("part").combine_chunks(), seen.sort_by("pos")
    x = {k: np.frombuffer(b"".join(map(zlib.decompress, rows.column(k).to_pylist())), kind) for k, kind in RAW.items()}
    n, best = (seen.column(k).to_numpy().astype(np.int64) for k in ("n", "best"))
    n_best, count_sum = (pa.array(summed(summed(x["multiple"] * w[x["pair"]], x["unit_n"])[x["unit"]] * x["times"], x["doc_n"]), pa.int64()) for w in (best, n))
    flat = {k: rows.column(k).combine_chunks().flatten() for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")}
    return pa.table([*(flat[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), n_best, count_sum, flat["sha"]], [c.split()[0] for c in DIGEST.split(", ")])


def digest(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """DIGEST of every document: its tokens, groups and links, and how its links fare in the whole corpus."""
    blocks = materialize(blocks_of(docs, a, b, id_col, text_col, size), "aligned")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("a", "b"))).select("block", F.col("pos"), F.col("col.a").alias("a"), F.col("col.b").alias("b"))
    seen = entries.join(pair_counts(blocks), ["a", "b"]).select(F.col("block").alias("of"), "pos", "n", "best")
    return blocks.select(*KEPT).groupBy("block").cogroup(seen.groupBy("of")).applyInArrow(_scored, DIGEST)


def groups(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's groups, see GROUPS: byte range in space+text, with A's and B's ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tables(a, b)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                got = of.ids(text) if text else None
                rows = []
                if got:
                    ends = np.cumsum(of.length_a[got[0]])
                    x = y = first = 0
                    for p, q in zip(*(g.tolist() for g in closed(ends, np.cumsum(of.length_b[got[1]]))), strict=True):
                        rows.append({"first": first, "past": int(ends[p - 1]), "a": got[0][x:p].tolist(), "b": got[1][y:q].tolist()})
                        x, y, first = p, q, int(ends[p - 1])
                ids.append(doc_id)
                found.append(rows)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "groups"])

    return texts(docs, id_col, text_col).mapInArrow(run, GROUPS)
