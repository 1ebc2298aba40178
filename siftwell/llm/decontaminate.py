"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ten consecutive words. A window's set is its shingles of two words (or its only
word), in one order for all: rarest in the documents first. A document holds a window only if it holds all of them, so
at containment 1 the necessary prefix is the single rarest shingle. Documents are joined on that shingle alone; its
position in the window bounds where the window must start and end, and the words there are compared one by one.

A benchmark of up to ``BLOCK_BYTES`` is sent to the executors as an index: two passes over the documents, one that
counts shingles and one that judges. A larger one is joined by shuffle: three passes, whatever its size. There a bitmap
of the wanted shingles, of bounded size, says which places of the documents are shuffled, with the words around them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freeing, text_bytes, utf8, written
from .wordhash import grams, hashes, mix, spans

WINDOW = 10
#: Bytes of benchmark text whose index is sent to the executors; the index takes about 30 times as much.
BLOCK_BYTES = 4 << 20
#: Bits of the largest bitmap of shingles that is sent (128 MB); a smaller one has 32 bits or more for each shingle.
MOST_BITS = 30
_CHUNK_BITS = 19

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and all characters beyond ASCII; A-Z lower-cased."""
    return _WORD.findall(text.encode().lower()) if text else []


def item_windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return list(zip(window, window[1:])) or [window]


def _held(document: list[bytes], wanted: frozenset, single: bool) -> set:
    """Which of the wanted shingles a document has."""
    found = wanted.intersection(zip(document, document[1:]))
    return found | wanted.intersection((w,) for w in document) if single else found


def _frequencies(docs: DataFrame, text_col: str, wanted) -> dict:
    """In how many documents each wanted shingle occurs, over all documents."""

    def f(batches):
        want, single = wanted.value
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(_held(words(t.as_py()), want, single))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["k", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(freeing(f), "k binary, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r.k).split(b" ")): r.n for r in rows}


class Index:
    """A small benchmark's distinct windows by their rarest shingle: shingle -> [(its place, first word, words' end, item ids)].

    Windows are places in the items' words, which are held once.
    """

    def __init__(self, items: list[tuple], size: int, frequency: dict) -> None:
        known: dict[bytes, bytes] = {}
        self.words: list[bytes] = []
        owners: dict[tuple, tuple[int, set]] = {}
        for item, text in items:
            base = len(self.words)
            self.words += [known.setdefault(w, w) for w in words(text)]
            for i, w in enumerate(item_windows(text, size)):
                owners.setdefault(w, (base + i, set()))[1].add(item)
        self.by: dict[tuple, list] = {}
        for w, (first, ids) in owners.items():
            s = shingles(w)
            at = min(range(len(s)), key=lambda i: (frequency.get(s[i], 0), s[i], i))
            if s[at] in frequency:
                self.by.setdefault(s[at], []).append((at, first, first + len(w), tuple(sorted(ids, key=str))))
        self.keys = frozenset(self.by)
        self.single = any(len(k) == 1 for k in self.keys)

    def find(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(start, end) of each occurring window, and the items they are of."""
        found = _held(document, self.keys, self.single)
        hits, items = [], set()
        if not found:
            return hits, items
        firsts = {k[0] for k in found}
        for i, w in enumerate(document):
            if w in firsts:
                for key in ((w,), tuple(document[i : i + 2])) if self.single else (tuple(document[i : i + 2]),):
                    for at, first, last, ids in self.by.get(key, ()) if key in found else ():
                        start, end = i - at, i - at + last - first
                        if start >= 0 and end <= len(document) and document[start:end] == self.words[first:last]:
                            hits.append((start, end))
                            items.update(ids)
        return hits, items


def _merged(hits: list) -> list[int]:
    """Disjoint spans in order, as start, end, start, end, ..."""
    out: list[int] = []
    for i, j in sorted(hits):
        if out and i <= out[-1]:
            out[-1] = max(out[-1], j)
        else:
            out += [i, j]
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the input's columns, n_words, spans (start and end of hit words, in turn), n_hit, items.

    ``items`` (array of string, distinct, in order) are the ids of items with occurring windows. Input columns of the
    four names are replaced. A null text has no words and is clean; an item of a null or wordless text has no
    windows; a null item id marks words but is left out of ``items``. Repeated rows and null document ids are judged
    like any other row; an empty benchmark leaves all documents clean. Benchmarks of more than ``block_bytes`` of text
    are joined by shuffle, to the same effect.
    """
    items = items.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("t IS NOT NULL")
    keep = [c for c in docs.columns if c not in _RESULT]
    join = _by_index if text_bytes(items, "t") <= block_bytes else _by_shuffle
    return join(docs.select(*[F.col(f"`{c}`") for c in keep]), items, id_col, text_col, window)


_RESULT = ["n_words", "spans", "n_hit", "items"]


def _by_index(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The small benchmark's index at each executor."""
    spark = docs.sparkSession
    block = [(r.i, r.t) for r in items.collect()]  # of a checked size
    wanted = frozenset(s for _, t in block for w in item_windows(t, window) for s in shingles(w))
    sent = spark.sparkContext.broadcast((wanted, any(len(s) == 1 for s in wanted)))
    frequency = _frequencies(docs, text_col, sent) if wanted else {}
    sent.unpersist()
    index = spark.sparkContext.broadcast(Index(block, window, frequency))
    schema = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
    text = docs.columns.index(text_col)

    def f(batches):
        ix = index.value
        for b in batches:
            counts, places, found = [], [], []
            for t in b.column(text):
                w = words(t.as_py())
                hits, held = ix.find(w)
                counts.append(len(w))
                places.append(_merged(hits))
                found.append(sorted(i for i in held if i is not None))
            hit = [sum(x[1::2]) - sum(x[::2]) for x in places]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string()))], [*b.schema.names, *_RESULT])

    return docs.mapInArrow(freeing(f), schema)


class _Text:
    """The words of a batch of texts, and the hashes of their shingles."""

    def __init__(self, column: pa.Array) -> None:
        data, bounds = utf8(column)
        data = _FOLD[data]
        self.starts, self.ends, self.doc = spans(data, bounds)
        self.data, word = data.tobytes(), hashes(data, self.starts, self.ends)
        self.single, self.pair = mix(word + np.uint64(1)), grams(word, 2)
        self.inside = self.doc[1:] == self.doc[:-1]
        edge = np.searchsorted(self.doc, np.arange(len(bounds)))
        self.first, self.last = edge[:-1], edge[1:]

    def words(self, i: int, j: int) -> str:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)).decode()


def _shingled(windows: DataFrame) -> DataFrame:
    """(w, k, at, g): the hash of each shingle of each window (w, k)."""

    def f(batches):
        for b in batches:
            t = _Text(b.column(0))
            k = np.asarray(b.column(1))
            of = np.r_[t.doc[:-1][t.inside] if len(t.doc) else t.doc, np.flatnonzero(k == 1)]
            at = np.r_[np.flatnonzero(t.inside) - t.first[t.doc[:-1][t.inside]] if len(t.doc) else t.doc, np.zeros((k == 1).sum(), np.int64)]
            g = np.r_[t.pair[t.inside], t.single[t.first[k == 1]]]
            rows = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, pa.int32()), pa.array(g.view(np.int64))], ["w", "k", "at", "g"])

    return windows.select("w", "k").mapInArrow(f, "w string, k int, at int, g long")


def _bitmap(keys: DataFrame):
    """(broadcast of a bitmap of the distinct hashes g of ``keys``, its bits as a power of two)."""
    keys = keys.select("g").distinct()
    bits = min(MOST_BITS, max(_CHUNK_BITS + 1, (32 * keys.count()).bit_length()))

    def f(table: pa.Table) -> pa.Table:
        ones = np.zeros(1 << _CHUNK_BITS, bool)
        ones[table["place"].to_numpy() & ((1 << _CHUNK_BITS) - 1)] = True
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(ones).tobytes()], pa.binary())})

    places = keys.select(F.shiftrightunsigned("g", 64 - bits).alias("place")).withColumn("chunk", F.shiftright("place", _CHUNK_BITS))
    size = 1 << _CHUNK_BITS - 3
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in places.groupBy("chunk").applyInArrow(f, "chunk long, bits binary").toLocalIterator():  # 128 MB at most
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out), bits


def _wanted(g: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = g >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _by_shuffle(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Any benchmark: its windows and the documents' places meet at the rarest shingle of each window."""

    def cut(batches):
        for b in batches:
            rows = {(r, " ".join(x.decode() for x in w), len(w)) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in item_windows(t, window)}
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["i", "w", "k"])

    owned = written(items.mapInArrow(cut, "i string, w string, k int").distinct(), "windows")
    shingled = written(_shingled(owned.select("w", "k").distinct()), "shingles")
    single = not shingled.filter("k = 1").isEmpty()
    sent, bits = _bitmap(shingled)

    def counted(batches):
        for b in batches:
            t = _Text(b.column(0))
            g = np.r_[t.pair[t.inside], t.single if single else t.single[:0]]
            key, n = np.unique(g[_wanted(g, sent.value, bits)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["g", "n"])

    text = F.col(f"`{text_col}`")
    counts = docs.select(text.alias("t")).mapInArrow(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    # a window of which some shingle is in no document occurs in none
    rarest = shingled.join(counts, "g").groupBy("w", "k").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "g", "at")).alias("least"))
    prefix = written(rarest.filter(F.col("have") == F.greatest(F.col("k") - 1, F.lit(1))).select("w", "k", "least.g", "least.at"), "prefixes")
    near, near_bits = _bitmap(prefix)
    reach = window - 2

    def placed(batches):
        for b in batches:
            t = _Text(b.column(2))
            out: list[tuple] = []
            for g, of in ((t.pair, np.flatnonzero(t.inside)), (t.single, np.arange(len(t.single) if single else 0))):
                of = of[_wanted(g[of], near.value, near_bits)]
                for i, d, h in zip(of.tolist(), t.doc[of].tolist(), g[of].view(np.int64).tolist(), strict=True):
                    low = max(int(t.first[d]), i - reach)
                    out.append((d, h, i - int(t.first[d]), i - low, t.words(low, min(int(t.last[d]), i + 2 + reach))))
            rows = b.take(pa.array([x[0] for x in out], pa.int64()))
            columns = zip(*[x[1:] for x in out], strict=True) if out else ([], [], [], [])
            more = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *more], ["id", "fp", "g", "place", "before", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.withColumns({"_id": F.col(f"`{id_col}`"), "_fp": F.md5(F.coalesce(text, F.lit("")))})  # equal rows are judged alike
    places = keyed.select("_id", "_fp", text).mapInArrow(placed, f"id {kind}, fp string, g long, place long, before int, words string")
    here = F.array_join(F.slice(F.split("words", " "), F.col("before") - F.col("at") + 1, F.col("k")), " ")
    met = places.join(prefix, "g").filter(F.col("before") >= F.col("at")).filter(here == F.col("w"))
    hits = written(met.select("id", "fp", (F.col("place") - F.col("at")).cast("int").alias("low"), (F.col("place") - F.col("at") + F.col("k")).cast("int").alias("high"), "w").distinct(), "hits")

    def merged(batches):
        for b in batches:
            found = [_merged([(x["low"], x["high"]) for x in row]) for row in b.column(2).to_pylist()]
            hit = [sum(x[1::2]) - sum(x[::2]) for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.list_(pa.int32())), pa.array(hit, pa.int64())], ["id", "fp", "spans", "n_hit"])

    marked = hits.groupBy("id", "fp").agg(F.collect_set(F.struct("low", "high")).alias("at")).mapInArrow(merged, f"id {kind}, fp string, spans array<int>, n_hit long")
    named = hits.join(owned, "w").filter("i IS NOT NULL").groupBy("id", "fp").agg(F.array_sort(F.collect_set("i")).alias("items"))
    found = marked.alias("m").join(named.alias("n"), F.col("m.id").eqNullSafe(F.col("n.id")) & (F.col("m.fp") == F.col("n.fp")), "left").select("m.id", "m.fp", "spans", "n_hit", "items")
    out = keyed.join(found, keyed["_id"].eqNullSafe(found["id"]) & (keyed["_fp"] == found["fp"]), "left")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select(*[keyed[c] for c in docs.columns], n_words.alias("n_words"), F.coalesce("spans", none("int")).alias("spans"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none("string")).alias("items"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
places AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS k, least(10, len(w)) AS n FROM places),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, sizes),
grams AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM starts),
hits AS (SELECT doc_id, item_id, s, n FROM grams JOIN windows USING (k, n)),
marked AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM hits),
counts AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""
