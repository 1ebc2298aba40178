"""Token ids in binary: one wavelet matrix per shard, in one compressed file.

File, little-endian: ``SWWM0003``; long n tokens, bits, documents, bits of a block, distinct tokens, documents without
an id, which are the last; the distinct tokens in order, whose places among themselves are what the planes hold; document ids; document starts (one more than
documents); for each plane from the highest bit down: long zeros in the plane, ones before each block, place of each
block (one more than blocks). Then the blocks, zstandard-compressed bits. A reader loads the directory and opens only
the blocks that a query touches.
"""

from __future__ import annotations

import io
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, parts_for, text_bytes, written
from .tokens import encoder, groups

MAGIC = b"SWWM0003"
#: Bits that are compressed, and worked on, at a time: few enough for a processor's cache.
BLOCK_BITS = 1 << 16
#: Bytes of text behind a partition, and the most tokens in one file.
SHARD_BYTES = 12 << 20
SHARD_TOKENS = 1 << 23
#: Tokens that a task reads back.
READ_TOKENS = 1 << 23
_PARTS = 1024  # partitions whose tokens are summed up at once


def build(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, block_bits: int = BLOCK_BITS, nameless: int = 0) -> bytes:
    """The file of a shard: ``ids`` of all its documents in a row; ``starts`` has each one's first place and the end.

    The last ``nameless`` documents have no id, whatever ``doc_ids`` says of them.
    """
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(seen)
    n, bits = len(ids), max(1, (len(alphabet) - 1).bit_length())
    code = np.zeros(len(seen), np.uint16 if bits <= 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    a = code[ids]
    kind, press = a.dtype.type, zstandard.ZstdCompressor(level=1)
    planes, blocks, at = [], [], 0
    ones = np.empty_like(a)
    for p in range(bits - 1, -1, -1):
        before, places, zero, one = [], [at], 0, 0
        for i in range(0, n, block_bits):
            part = a[i : i + block_bits]
            bit = (part & kind(1 << p)) != 0
            before.append(one)
            blocks.append(press.compress(np.packbits(bit).tobytes()))
            at += len(blocks[-1])
            places.append(at)
            low, high = part.take(np.flatnonzero(~bit)), part.take(np.flatnonzero(bit))
            a[zero : zero + len(low)] = low  # what it overwrites has been read
            ones[one : one + len(high)] = high
            zero, one = zero + len(low), one + len(high)
        planes.append(np.r_[zero, before, places].astype("<i8").tobytes())
        a[zero:] = ones[:one]
    head = np.array([n, bits, len(doc_ids), block_bits, len(alphabet), nameless], "<i8").tobytes()
    return b"".join([MAGIC, head, alphabet.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), *planes, *blocks])


class Shard:
    """Queries on a shard's file: ``f`` is any seekable binary file."""

    def __init__(self, f) -> None:
        self.f = f
        if f.read(8) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n, self.bits, docs, self.block_bits, distinct, self.nameless = (int(x) for x in self._longs(6))
        self.alphabet = self._longs(distinct)
        self.doc_ids, self.starts = self._longs(docs), self._longs(docs + 1)
        blocks = -(-self.n // self.block_bits)
        self.zeros, self.before, self.places = [], [], []
        for _ in range(self.bits):
            row = self._longs(2 + 2 * blocks)
            self.zeros.append(int(row[0]))
            self.before.append(row[1 : 1 + blocks])
            self.places.append(row[1 + blocks :])
        self.base = f.tell()
        self._block = lru_cache(64)(self._read_block)

    def _longs(self, n: int) -> np.ndarray:
        return np.frombuffer(self.f.read(8 * n), "<i8")

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        i, j = self.places[plane][block], self.places[plane][block + 1]
        self.f.seek(self.base + int(i))
        size = min(self.block_bits, self.n - block * self.block_bits)
        return np.unpackbits(np.frombuffer(zstandard.decompress(self.f.read(int(j - i))), np.uint8), count=size).view(bool)

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, rest = divmod(i, self.block_bits)
        if not rest:
            return int(self.before[plane][block]) if block < len(self.before[plane]) else self.n - self.zeros[plane]
        return int(self.before[plane][block]) + int(np.count_nonzero(self._block(plane, block)[:rest]))

    def _find(self, plane: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.before[plane] if one else np.arange(len(self.before[plane])) * self.block_bits - self.before[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._block(plane, block)
        return block * self.block_bits + int(np.flatnonzero(bits if one else ~bits)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            block, rest = divmod(i, self.block_bits)
            one, ones = bool(self._block(p, block)[rest]), self._ones(p, i)
            token = token << 1 | one
            i = self.zeros[p] + ones if one else i - ones
        return int(self.alphabet[token])

    def _code(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the token's occurrences begin, and where those before place i end."""
        code = self._code(token)
        if code < 0:
            return 0, 0
        low, high = 0, i
        for p in range(self.bits):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if code >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int | None = None) -> int:
        """How often the token occurs before place i, or at all."""
        low, high = self._range(token, self.n if i is None else min(max(i, 0), self.n))
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i, code = low + k, self._code(token)
        for p in range(self.bits - 1, -1, -1):
            one = bool(code >> (self.bits - 1 - p) & 1)
            i = self._find(p, one, i - self.zeros[p] if one else i)
        return i

    def names(self) -> list[int | None]:
        """The id of each document, or None."""
        ids = self.doc_ids.tolist()
        return ids[: len(ids) - self.nameless] + [None] * self.nameless

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by access to its places alone."""
        return np.array([self.access(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))], np.uint32)

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            up, zero, one = np.empty(self.n, kind), 0, self.zeros[p]
            for b in range(len(self.before[p])):
                bit = self._read_block(p, b)
                part = up[b * self.block_bits : b * self.block_bits + len(bit)]
                low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
                part[low] = a[zero : zero + len(low)]
                part[high] = a[one : one + len(high)] | kind(1 << (self.bits - 1 - p))
                zero, one = zero + len(low), one + len(high)
            a = up
        return self.alphabet.astype(np.uint32)[a]


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"file://{uri}")


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents and write them, in rising order of id, to shards in ``folder``, a URI that all share.

    ``end_id`` follows each document. Returns the manifest, written beside them: file, part, seq (the shards' order),
    n_docs, n_tokens. Files have names of their own for each attempt and only those of the manifest count, so a task
    that runs twice does no harm. A null text is empty, a null id comes last and stays null; rows of one id are in order
    of a hash of their text, rows of neither one after the other. An empty table gives no file.
    """
    spark = docs.sparkSession
    parts = parts_for(spark, text_bytes(docs, text_col), shard_bytes)

    def f(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        fs, root = filesystem(folder)
        ids, sizes, held, count = [], [], [], 0

        def flush():
            nonlocal seq, ids, sizes, held
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.swm"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(build(np.concatenate(ids), np.array([d or 0 for d in held], np.int64), np.r_[0, np.cumsum(sizes)], nameless=held.count(None)))
            row = [name, part, seq, len(held), int(sum(sizes))]
            ids, sizes, held, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        names, enc = ["file", "part", "seq", "n_docs", "n_tokens"], encoder(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for i, j in groups(b.column(1)):
                for doc, x in zip(b.column(0)[i:j].to_pylist(), enc.encode(b.column(1)[i:j].to_pylist()), strict=True):
                    if held and count + len(x) + 1 > shard_tokens:
                        yield flush()
                        count = 0
                    count += len(x) + 1
                    ids.append(np.append(x, end_id).astype(np.uint32))
                    sizes.append(len(x) + 1)
                    held.append(doc)
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(f, "file string, part long, seq long, n_docs long, n_tokens long"), "shards")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files of ``manifest``.

    ``start`` counts the ids of all documents before it; files are summed up by runs of partitions, and those by
    themselves, so no task sees all files and none is listed on the driver.
    """
    spark = manifest.sparkSession
    files = manifest.select("file", "part", "seq", "n_tokens", F.shiftright("part", _PARTS.bit_length() - 1).alias("run"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = files.groupBy("run").agg(F.sum("n_tokens").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("run").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("own", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(runs, "run")
    total = manifest.agg(F.sum("n_tokens")).first()[0] or 0
    plan = placed.select("file", (F.col("base") + F.col("own")).alias("begin")).repartition(parts_for(spark, total, READ_TOKENS))

    def f(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(io.BytesIO(file.read()))
                ids = shard.tokens().astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.names(), pa.int64()), pa.array(shard.starts[:-1] + base), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(f, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)
