"""Token ids as binary files: each id in the fewest bits that the vocabulary needs, in blocks with stored offsets.

A corpus is a folder of shards with a manifest (a Parquet table, a row for each shard). The content is range-partitioned
and sorted by doc_id, so shard k + 1 goes on where shard k ends. A shard is

    8 bytes   magic
    blocks    BLOCK ids each, id k of a block at bit k * width, lowest bit first; a block begins at a byte
    footer    int64 doc ids, uint8 marks of missing doc ids, int64 starts (documents + 1), int64 block offsets (blocks + 1),
              uint32 crc32 of each block
    trailer   64 bytes: uint64 width, vocabulary, ids in a block, documents, ids, blocks, the footer's offset; magic

and is written front to back, so any store will do that pyarrow.fs writes to (file, hdfs, s3, gs). A task writes under a
name of its own attempt, and the manifest has just the rows of the attempts that Spark committed: a lost executor's
files are read by nobody, and sweep() removes them. Blocks have one width, so a position is found by arithmetic, a
range of ids reads its own blocks only and a block is unpacked by one numpy expression. Memory is bounded by a block and
by 17 bytes for each document of a shard, never by a document's ids.

Results for odd input: a null text is empty, and an empty document is its end id alone; a null doc_id comes after all
others and is read back as null; rows that repeat are documents of their own, in the order of their texts; strings like
"<|endoftext|>" in a text get their own ids, as the tokenizer gives them by default; an empty table gives no shards. Only
id and text are read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns, texts
from tessera.session import materialize, scratch_folder

MAGIC = b"TESSERA\x01"
TRAILER = struct.Struct("<7Q8s")
END = 2
#: Ids of a block: a multiple of eight, so that every full block ends at a byte.
BLOCK = 4096
#: Blocks that a scan reads at once, and characters of new words that are encoded at once.
READ = 64
STRETCH = 20_000
MANIFEST = "partition int, shard string, documents long, ids long, bytes long, first_doc long, last_doc long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """Bits of the largest id; one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Fixed-width packing, lowest bit first, the last byte filled with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, width: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th on: each is read as the 8 bytes from its first byte on, shifted and masked."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n, first * width // 8).astype("<u4")
    words = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    bit = (first + np.arange(n, dtype=np.int64)) * width
    return (words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype("<u4")


class LibraryEncoder:
    """Ids by the tokenizers library, through a cache of words: a space before another character always begins a new token.

    The words that a batch of texts has and the cache hasn't are joined by spaces and encoded together; the tokens' byte
    ends tell them apart. Added tokens in a text get their own ids.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task is Spark's unit of parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.vocabulary, np.int64)
        for piece, k in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = len(piece)  # the vocabulary writes each byte as one character
        self.most = most
        self.words: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()  # no offsets

    def learn(self, words: Iterable[str]) -> None:
        """Puts space+word into the cache for all words."""
        held: list[str] = []
        size = 0
        for w in words:
            if not w or w != w.strip():
                self.words[w] = self.plain(" " + w)
                continue
            held.append(w)
            size += len(w) + 1
            if size >= STRETCH:
                self.put(held)
                held, size = [], 0
        if held:
            self.put(held)

    def put(self, words: list[str]) -> None:
        raw = self.plain(" " + " ".join(words))
        at = 4 * (np.searchsorted(np.cumsum(self.bytes[np.frombuffer(raw, "<u4")]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1)
        low = 0
        for w, high in zip(words, at.tolist(), strict=True):
            self.words[w] = raw[low:high]
            low = high

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [None if "  " in t or any(x in t for x in self.added) else t.split(" ") for t in texts]
        if len(self.words) > self.most:
            self.words.clear()
        known = self.words
        self.learn({w: None for parts in split if parts for w in parts[1:] if w not in known})
        for t, parts in zip(texts, split, strict=True):
            yield np.frombuffer(self.plain(t) if parts is None else self.plain(parts[0]) + b"".join(map(known.__getitem__, parts[1:])), "<u4")


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


class ShardWriter:
    """Appends documents to a stream; keeps at most a block of ids and the documents' table."""

    def __init__(self, out: pa.NativeFile, vocabulary: int, block: int = BLOCK):
        self.out, self.vocabulary, self.width, self.block = out, vocabulary, width_of(vocabulary), block
        self.docs: list[int | None] = []
        self.starts, self.offsets, self.sums = [0], [len(MAGIC)], []
        self.rest = np.zeros(0, "<u4")
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            self.put(ids[a:a + self.block])
        self.rest = ids[full:]

    def put(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.width)
        self.out.write(raw)
        self.sums.append(zlib.crc32(raw))
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> int:
        """Writes what is left and the tables; the file's size."""
        if len(self.rest):
            self.put(self.rest)
        missing = np.array([d is None for d in self.docs], "u1")
        tables = b"".join((
            np.array([d or 0 for d in self.docs], "<i8").tobytes(), missing.tobytes(), np.array(self.starts, "<i8").tobytes(),
            np.array(self.offsets, "<i8").tobytes(), np.array(self.sums, "<u4").tobytes()))
        self.out.write(tables)
        self.out.write(TRAILER.pack(self.width, self.vocabulary, self.block, len(self.docs), self.starts[-1], len(self.sums), self.offsets[-1], MAGIC))
        self.out.close()
        return self.offsets[-1] + len(tables) + TRAILER.size


class Shard:
    """Reads a shard: its tables at once, its ids as asked for."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError("not a shard: too short")
        self.width, self.vocabulary, self.block, docs, self.ids, blocks, footer, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a shard: wrong magic")
        raw = source.read_at(size - TRAILER.size - footer, footer)
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        self.docs, self.missing, self.starts = take("<i8", docs), take("u1", docs), take("<i8", docs + 1)
        self.offsets, self.sums = take("<i8", blocks + 1), take("<u4", blocks)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks [first, last), each held against its checksum."""
        base = int(self.offsets[first])
        raw = self.source.read_at(int(self.offsets[last]) - base, base)
        for k in range(first, last):
            if zlib.crc32(raw[int(self.offsets[k]) - base:int(self.offsets[k + 1]) - base]) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
        return unpack_bits(raw, min(last * self.block, self.ids) - first * self.block, self.width)

    def range(self, first: int, past: int) -> np.ndarray:
        """Ids [first, past) of the shard; reads the blocks that hold them and no others."""
        if not 0 <= first <= past <= self.ids:
            raise IndexError(f"[{first}, {past}) of {self.ids} ids")
        if first == past:
            return np.zeros(0, "<u4")
        low = first // self.block
        return self.blocks(low, -(-past // self.block))[first - low * self.block:past - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))

    def scan(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document, a stretch of its ids, whether it is the last one), from front to back, READ blocks at a time."""
        k, blocks = 0, len(self.sums)
        for low in range(0, blocks, READ):
            ids = self.blocks(low, min(blocks, low + READ))
            begin, pos = low * self.block, 0
            while pos < len(ids):
                stop = min(len(ids), int(self.starts[k + 1]) - begin)
                yield k, ids[pos:stop], stop + begin == self.starts[k + 1]
                k += stop + begin == self.starts[k + 1]
                pos = stop


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of docs into folder (a URI that driver and executors share); returns the manifest (MANIFEST), itself
    a table in folder/manifest. tokenizer: path of the byte-level BPE's JSON file, on every worker. end: id after each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            ids, contents = columns(b, "doc_id", "text")
            tokens = encoder(tokenizer)
            for doc_id, of in zip(ids, tokens.encode(contents), strict=True):
                if shard is None:
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:07d}-{uuid.uuid4().hex}.ids"
                    store, root = pafs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    shard = ShardWriter(store.open_output_stream(f"{root}/{name}"), tokens.vocabulary, block)
                shard.add(doc_id, np.append(of, np.uint32(end)))
        if shard is not None:
            size = shard.close()
            row = (part, name, len(shard.docs), shard.starts[-1], size, shard.docs[0], shard.docs[-1])
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)

    last = F.col("doc_id").asc_nulls_last()
    keyed = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    ordered = keyed.repartitionByRange(n, last, "h", "tie").sortWithinPartitions(last, "h", "text").select("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(docs, folder)


def manifest(near: DataFrame, folder: str) -> DataFrame:
    """The committed shards of folder with start, the ids before each. A row for each shard: one task can hold them."""
    rows = near.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def sweep(shards: DataFrame, folder: str) -> list[str]:
    """Removes the shards that no manifest row names (of tasks that were lost or overtaken); their names."""
    store, root = pafs.FileSystem.from_uri(folder)
    known = {r.shard for r in shards.select("shard").collect()}
    stray = [f for f in store.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".ids") and f.base_name not in known]
    for f in stray:
        store.delete_file(f.path)
    return sorted(f.base_name for f in stray)


def _dealt(shards: DataFrame) -> DataFrame:
    """A shard to a task, as far as there are tasks."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("shard", "start").repartition(n)


def _opened(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, int]]:
    store, root = pafs.FileSystem.from_uri(folder)
    for b in batches:
        for name, start in zip(*columns(b, "shard", "start"), strict=True):
            with store.open_input_file(f"{root}/{name}") as source:
                yield Shard(source), start


def read(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, start in _opened(folder, batches):
            held: list[np.ndarray] = []
            for k, ids, done in shard.scan():
                held.append(ids)
                if done:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if shard.missing[k] else int(shard.docs[k])], pa.int64()), pa.array([start + int(shard.starts[k])], pa.int64()),
                        pa.array([np.concatenate(held).astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])
                    held = []

    return _dealt(shards).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digest(shards: DataFrame, folder: str, rows: int = 4096) -> DataFrame:
    """DIGEST of every document, from the files; long documents go by in stretches."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for shard, start in _opened(folder, batches):
            crc = 0
            for k, ids, done in shard.scan():
                crc = zlib.crc32(ids.tobytes(), crc)
                if done:
                    out.append((None if shard.missing[k] else int(shard.docs[k]), start + int(shard.starts[k]), int(shard.starts[k + 1] - shard.starts[k]), crc))
                    crc = 0
                    if len(out) >= rows:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return _dealt(shards).mapInArrow(run, DIGEST)


def windows(requests: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Random access: position, length and ids of each request, a window of the corpus's ids; what lies past the end is left out.

    A request that crosses shards is cut into one for each, which are joined again; only the blocks in the windows are read.
    """
    # One number for each shard, as in any file listing.
    known = sorted((r.start, r.ids, r.shard) for r in shards.select("start", "ids", "shard").collect())
    starts = np.array([s for s, _, _ in known], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        at, shard, source = -1, None, None
        for b in batches:
            out: list[np.ndarray] = []
            for position, length in zip(*columns(b, "position", "length"), strict=True):
                parts: list[np.ndarray] = []
                k, past = max(0, int(np.searchsorted(starts, position, "right")) - 1), position + length
                while k < len(known) and known[k][0] < past:
                    start, n, name = known[k]
                    if k != at:
                        if source is not None:
                            source.close()
                        source = store.open_input_file(f"{root}/{name}")
                        at, shard = k, Shard(source)
                    low, high = max(position - start, 0), min(past - start, n)
                    if low < high:
                        parts.append(shard.range(low, high))
                    k += 1
                out.append(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], ["position", "length", "ids"])
        if source is not None:
            source.close()

    wanted = requests.select(F.col("position").cast("long").alias("position"), F.col("length").cast("long").alias("length"))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartitionByRange(n, "position").sortWithinPartitions("position").mapInArrow(run, "position long, length long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs into the shared folder and gives the DIGEST of what is read back."""
    folder = scratch_folder(docs.sparkSession, "ids")
    return digest(materialize(write(docs, folder, tokenizer), "shards"), folder)
