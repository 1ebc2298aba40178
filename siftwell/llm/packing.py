"""Sum-of-squares online packing of token ids into windows.

Each window has a fill level. A level array counts the open windows of each level; a document goes to the level (or a
new window) that leaves the sum of squared counts least. Only what is longer than a window is cut on the way. At the
end of a partition the windows still open are placed once more by the same rule, the fullest first, each as a whole;
what can't be filled that way is poured together and cut anew, so one sequence of a partition at most is left unfilled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing
from .tokens import encoder, groups

WINDOW = 1024


class Packer:
    """Packs one stream of documents. ``put`` and ``close`` return closed windows: lists of (doc, start, ids, total)."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window, np.int64)  # open windows of each level
        self.open: list[list] = [[] for _ in range(window)]

    def _level(self, size: int) -> int:
        """The level, 0 for a new window, where ``size`` tokens leave the least sum of squares; the fullest of equals."""
        n = self.count
        levels = np.flatnonzero(n[: self.window - size + 1])
        if not len(levels):
            return 0
        to = levels + size
        full = to == self.window
        cost = np.where(full, 1 - 2 * n[levels], 2 + 2 * (n[np.where(full, 0, to)] - n[levels]))
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[best]) if cost[best] <= 2 * n[size] + 1 else 0

    def put(self, doc, ids: np.ndarray) -> list[list]:
        out, total, w = [], len(ids), self.window
        cut = total - total % w
        for i in range(0, cut, w):
            out.append([(doc, i, ids[i : i + w], total)])
        size = total - cut
        return out + self._place([(doc, cut, ids[cut:], total)], size) if size else out

    def _place(self, pieces: list, size: int) -> list[list]:
        """Put pieces of together ``size`` tokens into the window that the level array says; the window if that fills it."""
        level = self._level(size)
        held = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        held = [*held, *pieces]
        if level + size == self.window:
            return [held]
        self.open[level + size].append(held)
        self.count[level + size] += 1
        return []

    def close(self) -> list[list]:
        """The windows still open, placed among themselves and then poured together."""
        out, left = [], [(size, pieces) for size in range(self.window - 1, 0, -1) for pieces in self.open[size]]
        self.__init__(self.window)
        for size, pieces in left:
            out += self._place(pieces, size)
        held, room = [], self.window
        for windows in reversed(self.open):
            for piece in (p for x in windows for p in x):
                doc, start, ids, total = piece
                while len(ids):
                    held.append((doc, start, ids[:room], total))
                    taken = len(held[-1][2])
                    start, ids, room = start + taken, ids[taken:], room - taken
                    if not room:
                        out.append(held)
                        held, room = [], self.window
        self.__init__(self.window)
        return [*out, held] if held else out


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each in its place in a sequence of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array of int) if asked for.
    ``end_id`` follows each document, so an empty or null text has one token. Every id lies in one piece, and
    a sequence's pieces lie from offset 0 on without gaps; only the last sequence of a partition may be unfilled.
    Sequences are numbered by partition, so there is no exchange; read ``docs`` from files, whose partitions a retry
    finds again as they were. Null ids and repeated rows are packed like any other; an empty table gives no piece.
    """

    def f(batches):
        from pyspark import TaskContext

        enc, packer, number = encoder(path), Packer(window), TaskContext.get().partitionId() << 33

        def rows(closed):
            nonlocal number
            docs_, starts, lengths, crcs, totals, seqs, offsets, ids = [], [], [], [], [], [], [], []
            for held in closed:
                offset = 0
                for doc, start, x, total in held:
                    docs_.append(doc)
                    starts.append(start)
                    lengths.append(len(x))
                    crcs.append(zlib.crc32(x))
                    totals.append(total)
                    seqs.append(number)
                    offsets.append(offset)
                    if with_ids:
                        ids.append(x.view(np.int32))
                    offset += len(x)
                number += 1
            longs = [pa.array(x, pa.int64()) for x in (docs_, starts, lengths, crcs, totals, seqs, offsets)]
            return pa.RecordBatch.from_arrays([*longs, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for b in batches:
            for i, j in groups(b.column(1)):
                closed = []
                for doc, x in zip(b.column(0)[i:j].to_pylist(), enc.encode(b.column(1)[i:j].to_pylist()), strict=True):
                    closed += packer.put(doc, np.append(x, end_id).astype("<u4"))
                yield rows(closed)
        yield rows(packer.close())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(freeing(f, keep=True), schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
