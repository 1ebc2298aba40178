"""Substring dedup by seed and extend over winnowed anchors.

A window is 13 consecutive words of one document. Its anchor is the first least hash of its 5-word runs (winnowing:
each window has one, neighbours mostly share it). Blocks of documents exchange anchors first. Around each anchor that
more than one document has, all its windows are laid out as one stretch of words, and the stretches of one anchor
meet: they are extended from it both ways, and two are the same there as far as their words are the same. Words are
compared as they are; hashes only bring together what is compared. A window that also starts in a document of a
smaller id is repeated; touching repeated windows merge to maximal repeats.

What is dealt out is one packed row for each block and hash range that the block has something of, with each anchor
or stretch once for each block, however many documents of the block hold it: a passage that a third of all documents
share costs a reducer one entry a block. An anchor that very many places have, mostly with other words around it, is
dealt out again by the whole windows around it. The documents are dealt to blocks once; the three passes reuse that
exchange.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts_for, release, text_bytes, utf8
from .wordhash import grams, hashes, mix, pack, pack_sorted, sliding, spans, unpack, unpack_sorted

WINDOW = 13
SEED = 5
#: Bytes of text in a block, and behind a range of hashes.
BLOCK_BYTES = 6 << 20
#: Places from which on an anchor is dealt out by the windows around it.
CROWD = 2000
_MOST = 127  # places of an anchor that a block reports; as many or more make it crowded by themselves
_KEEP = 48  # bits of an anchor's hash; a chance collision only costs a comparison
_NO_ID = np.iinfo(np.int64).max


class _Block(NamedTuple):
    """A block's documents in order of id and text, with their words, windows and anchors."""

    order: np.ndarray
    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    words: np.ndarray  # hashes
    at: np.ndarray  # first word of each window
    place: np.ndarray  # first word of each window's anchor
    anchor: np.ndarray  # hash of each window's anchor


def _block(table: pa.Table, window: int, seed: int) -> _Block:
    ids = table["_id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    order = pc.sort_indices(pa.table({"i": ids, "t": table["_text"]}), sort_keys=[("i", "ascending"), ("t", "ascending")])
    data, bounds = utf8(table["_text"].take(order))
    order = order.to_numpy()
    starts, ends, doc = spans(data, bounds)
    words = hashes(data, starts, ends)
    runs = grams(words, seed)
    least = sliding(np.minimum, runs, window - seed + 1)
    at = np.flatnonzero(doc[: len(least)] == doc[window - 1 : window - 1 + len(least)]) if len(least) else np.zeros(0, np.int64)
    least, place = least[at], at + window - seed
    for k in range(window - seed - 1, -1, -1):
        here = runs[at + k] == least
        place[here] = at[here] + k
    return _Block(order, ids[order], data, bounds, starts, ends, doc, words, at, place, mix(least) >> np.uint64(64 - _KEEP))


def _distinct(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each occurs, and whether documents of several numbers have it."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(keys)] - 1 if len(keys) else first
    return keys[first], last - first + 1, doc[first] != doc[last]


def _runs(b: _Block) -> np.ndarray:
    """Where, among the windows, each run of windows with one anchor begins, and the end of the last."""
    new = np.flatnonzero(b.place[1:] != b.place[:-1]) + 1
    return np.r_[0, new, len(b.at)] if len(b.at) else np.zeros(1, np.int64)


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges (leading ``bits`` bits) that sorted keys have, and the bounds of each."""
    of = (keys >> np.uint64(_KEEP - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return of[first], np.r_[first, len(of)]


_SENT = T.StructType([T.StructField("range", T.LongType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("extra", T.BinaryType()), T.StructField("words", T.BinaryType())])
_SENT_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary()), ("words", pa.binary())])
_REPLY = T.StructType([T.StructField("block", T.LongType()), T.StructField("round", T.IntegerType()), T.StructField("range", T.LongType()), T.StructField("bits", T.BinaryType())])
_REPLY_ARROW = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("range", pa.int64()), ("bits", pa.binary())])


def _sent(block: int, keys: np.ndarray, bits: int, extra, words=lambda i, j: None) -> pa.Table:
    of, cut = _cut(keys, bits)
    rows = [(r, block, pack_sorted(keys[i:j]), extra(i, j), words(i, j)) for r, i, j in zip(of.tolist(), cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, _SENT_ARROW, strict=True)], schema=_SENT_ARROW)


def _bit_rows(*marks: np.ndarray) -> bytes:
    return b"".join(np.packbits(m).tobytes() for m in marks)


def _anchors_of(window: int, seed: int, bits: int):
    def f(table: pa.Table) -> pa.Table:
        release()
        b = _block(table, window, seed)
        first = _runs(b)[:-1]
        keys, n, many = _distinct(b.anchor[first], b.ids[b.doc[b.at[first]]])
        seen = (np.minimum(n, _MOST) | many.astype(np.int64) << 7).astype(np.uint8)
        return _sent(table["_block"][0].as_py(), keys, bits, lambda i, j: seen[i:j].tobytes())

    return f


def _gathered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of all rows' keys, and in it each group's first place and size."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, first, np.diff(np.r_[first, len(every)])


def _replies(table: pa.Table, round_: int, bits: list[bytes]) -> pa.Table:
    return pa.Table.from_pydict({"block": table["block"], "round": pa.array([round_] * len(bits), pa.int32()), "range": table["range"], "bits": bits}, schema=_REPLY_ARROW)


def _shared_anchors(crowd: int):
    def f(table: pa.Table) -> pa.Table:
        """Which anchors several documents have, and which of them very many places have."""
        release()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        seen = np.concatenate([np.frombuffer(x, np.uint8) for x in table["extra"].to_pylist()])
        order, first, counts = _gathered(keys)
        n = (seen & 127).astype(np.int64)[order]
        shared = (counts > 1) | (np.maximum.reduceat(seen[order], first) > 127)
        crowded = (np.add.reduceat(n, first) >= crowd) | (np.maximum.reduceat(n, first) >= min(crowd, _MOST))
        marks = np.empty((2, len(order)), bool)
        marks[:, order] = np.repeat([shared, shared & crowded], counts, axis=1)
        cut = np.cumsum([0, *map(len, keys)])
        return _replies(table, 1, [_bit_rows(*marks[:, i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)])

    return f


def _marks(replies: pa.Table, round_: int, of: np.ndarray, cut: np.ndarray, rows: int) -> np.ndarray:
    """The ``rows`` marks of a round for each of the block's keys; ``of`` and ``cut`` are its ranges."""
    out = np.zeros((rows, int(cut[-1])), bool)
    for r, x, bits in zip(replies["range"].to_pylist(), replies["round"].to_pylist(), replies["bits"].to_pylist(), strict=True):
        if x == round_:
            k = int(np.searchsorted(of, r))
            n = int(cut[k + 1] - cut[k])
            each = np.frombuffer(bits, np.uint8).reshape(rows, -1)
            out[:, cut[k] : cut[k + 1]] = np.unpackbits(each, axis=1, count=n)
    return out


class _Stretches(NamedTuple):
    """The distinct stretches of words around a block's shared anchors, in order of key."""

    texts: list[bytes]  # words joined by one space
    keys: np.ndarray
    doc: np.ndarray  # the first document with it
    windows: np.ndarray  # windows in it
    at: np.ndarray  # of each occurrence in the block: its first word
    which: np.ndarray  # and its stretch


def _joined(b: _Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of the block, those of one document joined by one space; start and end of each."""
    gap = b.ends < b.bounds[1:][b.doc]
    step = np.zeros(len(b.data) + 1, np.int8)
    step[b.starts] += 1
    step[b.ends + gap] -= 1
    text = b.data.copy()
    text[b.ends[gap]] = 0x20
    size = b.ends - b.starts
    start = np.cumsum(size + gap) - size - gap
    return text[np.cumsum(step[:-1], dtype=np.int8) > 0].tobytes(), start, start + size


def _stretches(b: _Block, replies: pa.Table, window: int, bits: int) -> _Stretches:
    edge = _runs(b)
    first = edge[:-1]
    keys, number = np.unique(b.anchor[first], return_inverse=True)
    shared, crowded = _marks(replies, 1, *_cut(keys, bits), 2)
    whole = np.flatnonzero((shared & ~crowded)[number])  # runs
    alone = np.flatnonzero(np.repeat(crowded[number], np.diff(edge)))  # windows
    low = np.r_[b.at[first[whole]], b.at[alone]]
    high = np.r_[b.at[edge[1:][whole] - 1], b.at[alone]] + window - 1
    key = keys[number[whole]]
    if len(alone):
        key = np.r_[key, grams(b.words, window)[b.at[alone]] >> np.uint64(64 - _KEEP)]
    order = np.argsort(low, kind="stable")
    low, high, key = low[order], high[order], key[order]
    text, start, end = _joined(b)
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(text[i:j], len(seen)) for i, j in zip(start[low].tolist(), end[high].tolist(), strict=True)], np.int64)
    _, at = np.unique(which, return_index=True)
    by = np.argsort(key[at], kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    texts = list(seen)
    return _Stretches([texts[i] for i in by], key[at][by], b.doc[low[at]][by], (high - low)[at][by] - window + 2, low, place[which] if len(which) else which)


def _stretches_of(window: int, seed: int, bits: int):
    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        if not docs.num_rows:
            return _SENT_ARROW.empty_table()
        b = _block(docs, window, seed)
        s = _stretches(b, replies, window, bits)
        least, press = b.ids[s.doc], zstandard.ZstdCompressor(level=1)
        return _sent(docs["_block"][0].as_py(), s.keys, bits, lambda i, j: pack(least[i:j]), lambda i, j: press.compress(b"\n".join(s.texts[i:j])))

    return f


def _extended(same: dict[bytes, int], window: int) -> dict[bytes, int]:
    """The least id of each window around an anchor: k words to its left and the others to its right, for each k."""
    least: dict[bytes, int] = {}
    for text, i in same.items():
        words = text.split(b" ")
        for k in range(len(words) - window + 1):
            w = b" ".join(words[k : k + window])
            least[w] = min(least.get(w, i), i)
    return least


def _earlier(window: int):
    def f(table: pa.Table) -> pa.Table:
        """For each window of each stretch, whether another block has its words in a document of a smaller id."""
        release()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        own = np.concatenate([unpack(x, np.int64) for x in table["extra"].to_pylist()])
        texts = [t for x in table["words"].to_pylist() for t in zstandard.decompress(x).split(b"\n")]
        order, first, counts = _gathered(keys)
        windows = np.array([t.count(b" ") for t in texts], np.int64) + 2 - window
        upto = np.r_[0, np.cumsum(windows)]
        all_of = np.zeros(len(texts), bool)
        marks = np.zeros(upto[-1], bool)
        ids = own.tolist()
        for g in np.flatnonzero(counts > 1).tolist():
            members = order[first[g] : first[g] + counts[g]].tolist()
            same: dict[bytes, int] = {}
            for m in members:
                t = texts[m]
                same[t] = min(same.get(t, ids[m]), ids[m])
            if len(same) == 1:
                (least,) = same.values()
                for m in members:
                    all_of[m] = ids[m] > least
                continue
            by = _extended(same, window)
            for m in members:
                words = texts[m].split(b" ")
                for k in range(windows[m]):
                    marks[upto[m] + k] = by[b" ".join(words[k : k + window])] < ids[m]
        marks |= np.repeat(all_of, windows)
        cut = upto[np.cumsum([0, *map(len, keys)])]
        return _replies(table, 2, [_bit_rows(marks[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)])

    return f


def _removed(b: _Block, replies: pa.Table, window: int, bits: int) -> np.ndarray:
    """Which words a window repeated from a document of a smaller id covers."""
    s = _stretches(b, replies, window, bits)
    if not len(s.keys):
        return np.zeros(len(b.words), bool)
    upto = np.r_[0, np.cumsum(s.windows)]
    of, cut = _cut(s.keys, bits)
    (earlier,) = _marks(replies, 2, of, upto[cut], 1)
    n = s.windows[s.which]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    other = np.repeat(b.ids[s.doc[s.which]] < b.ids[b.doc[s.at]], n)
    at = (np.repeat(s.at, n) + k)[other | earlier[np.repeat(upto[s.which], n) + k]]
    size = len(b.words) + 1
    return np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + window, minlength=size))[:-1] > 0


def _cleaned(window: int, seed: int, bits: int, out: pa.Schema):
    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        if not docs.num_rows:
            return out.empty_table()
        b = _block(docs, window, seed)
        gone = _removed(b, replies, window, bits)
        n = len(b.ids)
        kept = ~gone
        step = np.zeros(len(b.data) + 1, np.int8)  # a kept word's bytes and the byte after it, which becomes a space
        step[b.starts[kept]] += 1
        after = np.minimum(b.ends[kept] + 1, b.bounds[1:][b.doc[kept]])
        np.add.at(step, after, -1)
        keep = np.cumsum(step[:-1], dtype=np.int8) > 0
        text = b.data.copy()
        text[np.minimum(b.ends, len(text) - 1)[b.ends < b.bounds[1:][b.doc]]] = 0x20
        upto = np.r_[0, np.cumsum([np.count_nonzero(keep[i:j]) for i, j in zip(b.bounds[:-1], b.bounds[1:], strict=True)])]
        text = text[keep].tobytes()
        texts = [text[i:j].rstrip(b" ").decode() for i, j in zip(upto[:-1], upto[1:], strict=True)]
        counts = np.bincount(b.doc, minlength=n), np.bincount(b.doc[gone], minlength=n)
        docs = docs.take(pa.array(b.order))
        return pa.Table.from_arrays([docs["_id"].combine_chunks(), pa.array(texts, out.field("kept").type), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), docs["_carry"].combine_chunks().cast(out.field("_carry").type)], schema=out)

    return f


#: Blocks up to which each gets a partition of its own; of more, chance puts several in one and others in none.
EVEN = 4096


def _labels(spark: SparkSession, n: int) -> list[int]:
    """Numbers for ``n`` blocks that Spark's hash partitioning deals to ``n`` partitions one each."""
    rows = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    taken = [r.id for r in rows]
    return taken + [32 * n + i for i in range(n - len(taken))]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, block_bytes: int = BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """Remove every word covered by a window whose words also start in a document of a smaller id.

    Returns one row per input row: the input's columns, ``kept`` (the kept words joined by one space), ``n_words``
    and ``n_removed`` (long); input columns of those three names are replaced. Windows are judged on the input.
    A null text has no words and gives an empty ``kept``. A null id counts as greater than every id. Rows of one id
    never remove each other's words, so repeated rows stay as they are. Texts of fewer words than a window and empty
    tables lose nothing. Words are compared byte by byte; equal hashes of unlike words change nothing.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    total = text_bytes(docs, text_col)
    blocks, bits = parts_for(spark, total, block_bytes), max(3, (total // block_bytes).bit_length())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_carry"))
    block = F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))
    if blocks <= EVEN:
        block = F.element_at(F.lit(_labels(spark, blocks)).cast("array<long>"), (block + 1).cast("int"))
    rows = rows.select(block.alias("_block"), "*").repartition(blocks, "_block")
    anchors = rows.groupBy("_block").applyInArrow(_anchors_of(window, seed, bits), _SENT)
    shared = anchors.groupBy("range").applyInArrow(_shared_anchors(crowd), _REPLY)
    stretches = rows.groupBy("_block").cogroup(shared.groupBy("block")).applyInArrow(_stretches_of(window, seed, bits), _SENT)
    earlier = stretches.groupBy("range").applyInArrow(_earlier(window), _REPLY)
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("_carry", rows.schema["_carry"].dataType)])
    from pyspark.sql.pandas.types import to_arrow_schema

    cleaned = rows.groupBy("_block").cogroup(shared.unionByName(earlier).groupBy("block")).applyInArrow(_cleaned(window, seed, bits, to_arrow_schema(schema)), schema)
    return cleaned.select(*[F.col(f"_carry.`{c}`").alias(c) for c in keep], "kept", "n_words", "n_removed")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN firsts USING (k) WHERE doc_id > least),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' '), '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""
