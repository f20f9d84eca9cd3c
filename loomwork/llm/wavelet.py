"""Token ids in wavelet-matrix files: one succinct, compressed file a shard.

A shard holds the ids of consecutive documents in ascending doc_id order.  Its
file has one bit-plane per bit of the largest id, from the highest: bit b of
every id in the order that the planes above left them in, zeros moved before
ones for the next plane.  A directory in the file tells the ones before every
``STEP`` bits of a plane, and planes are compressed in blocks of ``BLOCK`` bits
by Zstandard; so access, counting and occurrence lookup take one rank or select
a plane and inflate only the blocks that they touch.

On disk a shard is a Parquet file of its own that Spark itself writes, so that
any Hadoop store can hold it and a lost executor's attempt leaves nothing
behind; its one row holds the shard's documents and the file format above.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.storage import keep

MAGIC = b"LWM2"
#: Bits between two entries of a plane's directory, and bits of a compressed block.
STEP, BLOCK = 512, 65_536
END_ID = 1
#: A shard is closed at the document that reaches so many ids.
SHARD_IDS = 2_000_000
#: Pieces whose ids a worker keeps, in each of two generations.
KEPT = 300_000
#: Bytes of text that are encoded at once; a longer text is encoded by itself.
SLICE_BYTES = 8_000_000

# The normaliser and splitter that :class:`Encoder` cuts texts for itself with.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def written(ids: np.ndarray) -> bytes:
    """The wavelet-matrix file of a sequence of ids."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16 if width <= 16 else np.uint32)
    zeros, ranks, blocks = [], [], []
    compress = zstandard.ZstdCompressor(level=1).compress
    for bit in range(width - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)).astype(bool)
        plane = np.packbits(ones, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), STEP // 8), dtype=np.int64) if len(plane) else []
        ranks.append(np.r_[0, np.cumsum(counts)].astype("<u4"))
        zeros.append(len(now) - int(ranks[-1][-1]))
        blocks += [compress(plane[at : at + BLOCK // 8].tobytes()) for at in range(0, len(plane), BLOCK // 8)]
        if bit:
            now = np.concatenate([now.compress(~ones), now.compress(ones)])
    head = MAGIC + struct.pack("<QI", len(ids), width) + np.array(zeros, "<u8").tobytes()
    return b"".join([head, *(r.tobytes() for r in ranks), np.array([len(b) for b in blocks], "<u4").tobytes(), *blocks])


class WaveletFile:
    """Access, counts and occurrences from a file's bytes; at most ``most`` inflated blocks are kept."""

    def __init__(self, data: bytes, most: int = 256):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.n, self.width = struct.unpack_from("<QI", data, 4)
        self.data, self.most, self.kept = memoryview(data), most, {}
        entries, self.blocks = -(-self.n // STEP) + 1, -(-self.n // BLOCK)
        at = 16
        self.zeros = np.frombuffer(data, "<u8", self.width, at).astype(int).tolist()
        at += 8 * self.width
        self.ranks = np.frombuffer(data, "<u4", self.width * entries, at).reshape(self.width, entries)
        at += 4 * self.width * entries
        sizes = np.frombuffer(data, "<u4", self.width * self.blocks, at)
        self.starts = at + 4 * len(sizes) + np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        self.inflate = zstandard.ZstdDecompressor().decompress

    def _block(self, plane: int, block: int) -> np.ndarray:
        at = plane * self.blocks + block
        if at not in self.kept:
            if len(self.kept) >= self.most:
                del self.kept[next(iter(self.kept))]
            self.kept[at] = np.frombuffer(self.inflate(self.data[self.starts[at] : self.starts[at + 1]]), np.uint8)
        return self.kept[at]

    def rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        ones, rest = int(self.ranks[plane, i // STEP]), i % STEP
        if not rest:
            return ones
        bits, start = self._block(plane, i // BLOCK), i % BLOCK // STEP * (STEP // 8)
        ones += int(np.bitwise_count(bits[start : start + rest // 8]).sum())
        return ones + (int(bits[start + rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else ones

    def select(self, plane: int, k: int, bit: int) -> int:
        """Where the k-th (from 0) bit of this value stands in a plane."""
        ahead = self.ranks[plane].astype(np.int64)
        if not bit:
            ahead = np.minimum(np.arange(len(ahead)) * STEP, self.n) - ahead
        step = int(np.searchsorted(ahead, k, side="right")) - 1
        start = step * STEP % BLOCK // 8
        part = self._block(plane, step * STEP // BLOCK)[start : start + STEP // 8]
        bits = np.unpackbits(part, bitorder="little")[: self.n - step * STEP]
        return step * STEP + int(np.flatnonzero(bits == bit)[k - int(ahead[step])])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for p in range(self.width):
            one = int(self._block(p, i // BLOCK)[i % BLOCK // 8]) >> i % 8 & 1
            ones = self.rank(p, i)
            i = self.zeros[p] + ones if one else i - ones
            value = value * 2 + one
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the value's occurrences before ``stop`` end up below the last plane."""
        a, b = 0, stop
        for p in range(self.width):
            one = value >> (self.width - 1 - p) & 1
            ra, rb = self.rank(p, a), self.rank(p, b)
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if one else (a - ra, b - rb)
        return a, b

    def count(self, value: int, stop: int | None = None) -> int:
        """Occurrences of a value among the first ``stop`` ids."""
        if value >> self.width:
            return 0
        a, b = self._range(value, self.n if stop is None else stop)
        return b - a

    def find(self, value: int, k: int) -> int:
        """Where the value's k-th (from 0) occurrence stands."""
        a, b = self._range(value, self.n) if not value >> self.width else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for p in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - p) & 1
            at = self.select(p, at - self.zeros[p] if one else at, one)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: from the last plane's order back to the first's."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.width - 1, -1, -1):
            edges = self.starts[p * self.blocks : (p + 1) * self.blocks + 1].tolist()
            plane = b"".join(self.inflate(self.data[a:b]) for a, b in zip(edges, edges[1:]))
            ones = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            bit, zeros = kind(1 << (self.width - 1 - p)), self.zeros[p]
            back = np.empty_like(now)
            back[np.flatnonzero(~ones)] = now[:zeros]
            back[np.flatnonzero(ones)] = now[zeros:] | bit
            now = back
        return now.astype(np.uint32)


class Encoder:
    """Ids of whole texts by a tokenizer file, as the library gives them.

    A file with :data:`NORMALIZER` and :data:`PRE_TOKENIZER` drops white space
    and never looks across it, so texts are cut at ASCII white space and each
    different chunk of a slice is encoded once.  Where a chunk's characters are
    all such that their normal form is their lower case (asked of the library for
    each up to U+024F), the splitter's pattern over these gives its pieces and the
    library's model their ids, which are kept; any other chunk, and one that holds
    an added token, goes through the library whole.  With any other tokenizer
    file whole texts do.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors' cores are Spark's to share out
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = made.get("added_tokens") or []
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and len(t["content"].split()) == 1 for t in added)
        self.by_chunk = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and made["model"]["type"] == "BPE" and not made["model"]["dropout"] and plain
        self.most = kept
        self.kept: dict[str, bytes] = {" ": b""}
        self.older: dict[str, bytes] = {}
        self.added = [t["content"] for t in added]
        if self.by_chunk:
            normal = self.tokenizer.normalizer.normalize_str
            known = [c for c in map(chr, range(0x21, 0x250)) if not c.isspace() and len(c.lower()) == 1 and normal(c) == c.lower()]
            kind = lambda p: "".join(re.escape(c) for c in known if regex.fullmatch(p, c))
            letters, digits = kind(r"\p{L}"), kind(r"\p{N}")
            # the splitter's pattern over the known characters, with the most frequent pieces first
            self.pieces = re.compile(f"[{letters}]+| |'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^ {letters}{digits}]+").findall
            self.known = {" ", *known}
            self.odd = re.compile("|".join(["[^" + "".join(map(re.escape, known)) + "]", *map(re.escape, self.added)])).search
            printed = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
            hidden = [b for b in range(256) if b not in printed]
            self.shown = {b: 256 + i for i, b in enumerate(hidden)}  # the byte-level alphabet: printed bytes stand for themselves

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learned(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            if self.odd(piece) and piece != " ":
                found = self._library(piece)
            else:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
                found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.kept[piece] = found
        return found

    def _ids(self, names: list[str]) -> list[bytes]:
        return [p if p is not None else self._learned(c) for c, p in zip(names, map(self.kept.get, names))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            found = [self._library(t.as_py()) for t in texts]
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(f) // 4 for f in found], np.int64)
        if len(self.kept) > self.most:  # what is used again comes over from the older generation
            self.kept, self.older = {" ": b""}, self.kept
        rows = pc.ascii_split_whitespace(texts)
        coded = rows.flatten().dictionary_encode()
        if not len(coded.dictionary):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        blob = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        chunks, odd = None, {}
        if not self.known.issuperset(blob) or any(t in blob for t in self.added):
            chunks = blob.split(" ")
            odd = {i: c for i, c in enumerate(chunks) if self.odd(c)}
            for i in odd:
                chunks[i] = ""
            blob = " ".join(chunks)
        names = self.pieces(blob.lower())  # pieces, and blanks between chunks
        parts = self._ids(names)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        chunk = np.cumsum(np.fromiter(map(" ".__eq__, names), bool, len(names)))
        size = np.bincount(chunk, weights=size, minlength=len(coded.dictionary)).astype(np.int64)
        begin = np.cumsum(size) - size
        pool = b"".join(parts)
        if odd:
            at, parts = np.array(list(odd)), self._ids(list(odd.values()))
            size[at] = [len(p) // 4 for p in parts]
            begin[at] = len(pool) // 4 + np.cumsum(size[at]) - size[at]
            pool = b"".join([pool, *parts])
        pool, at = np.frombuffer(pool, np.uint32), coded.indices.to_numpy()
        n = size[at]
        ends = np.r_[0, np.cumsum(n)]
        ids = pool[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[rows.offsets.to_numpy()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder: tasks that follow each other in it share what it keeps."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about SLICE_BYTES."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b > a:
            yield a, b - a


def write_shards(documents: DataFrame, tokenizer: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards to the shared folder, a file each, and returns a scan of them.

    (part, seq, doc_ids, counts, payload): documents in ascending doc_id order
    (null ids first, rows of one id by a hash of their text, then by text) are
    dealt to ranges of ids and hashes, so that rows of one id needn't meet in one
    task; the shards of a range are numbered, and each is closed at ``shard_ids``
    ids, so a task holds one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, docs, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            payload = written(np.concatenate(ids))
            cols = [
                pa.array([part], pa.int64()),
                pa.array([seq], pa.int64()),
                pa.ListArray.from_arrays([0, sum(map(len, docs))], pa.concat_arrays(docs)),
                pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_ids", "counts", "payload"])

        for batch in batches:
            for at, rows in _slices(batch.column(1)):
                found, n = encode(batch.column(1).slice(at, rows))
                found, n = np.insert(found, np.cumsum(n), END_ID), n + 1
                ends, own = np.cumsum(n), batch.column(0).slice(at, rows)
                first = 0
                while first < rows:
                    done = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, shard_ids - held + done)) + 1, rows)
                    ids.append(found[done : int(ends[last - 1])])
                    counts.append(n[first:last])
                    docs.append(own.slice(first, last - first))
                    held += len(ids[-1])
                    first = last
                    if held >= shard_ids:
                        yield shard()
                        ids, counts, docs, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    typed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = typed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shards = ordered.mapInArrow(run, "part bigint, seq bigint, doc_ids array<bigint>, counts array<bigint>, payload binary")
    return keep(shards, "wavelet", maxRecordsPerFile="1", compression="uncompressed")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files alone."""
    # one row per shard, without payloads; ranges are as many as partitions, so only their totals meet in one window
    sizes = shards.select("part", "seq", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("ahead"))
    offsets = inside.join(parts, "part").select("part", "seq", (F.col("base") + F.col("ahead")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, docs, counts, payload = (c[row] for c in batch.columns)
                ids = WaveletFile(payload.as_py()).all().astype("<u4")
                n = counts.values.to_numpy()
                ends = np.cumsum(n)
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(n), pa.int64()), pa.array([seq.as_py()] * len(n), pa.int64()), docs.values, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = shards.mapInArrow(run, "part bigint, seq bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes, writes, reads back: one row per document.

    A null or empty text has its end id alone; a null doc_id comes before all
    others; repeated rows are documents of their own; columns other than doc_id
    and text aren't read.
    """
    return read_documents(write_shards(documents, tokenizer))
