"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within four bits have a middle within two bits of both. Every distinct fingerprint emits its ball of
radius two (1 + 64 + 2016 variants), and those that meet at a variant are linked: by the triangle inequality any two
are within four bits, so a chain to the least one loses nothing and no group is expanded into its pairs.

Variants are dealt out by their leading bits. Only the flips among those bits are shuffled as rows; the task that gets
a prefix makes the flips that are left among the other bits. A prefix that too many fingerprints share (a large group
of near copies) is dealt out again by further bits, until each task's share of variants is bounded.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bottom, freeing, release, written

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Variants that one task makes for one prefix.
TASK_VARIANTS = 4_000_000
_STEP = 6  # bits by which a crowded prefix is extended


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer; zero for a null text and one of no words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(whole[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_hash: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long of the same bits; with ``row_hash`` also row."""
    also = [_row_hash(docs).alias("row")] if row_hash else []

    def f(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *also)
    return rows.mapInArrow(freeing(f), "doc_id long, fp long" + ", row long" * row_hash)


def _row_hash(docs: DataFrame):
    """Column: hash of a whole row, where the nulls are included."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _masks(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) of all ways to flip at most ``most`` of the bits low..high-1, bit 0 leading; signed longs."""
    out = []
    for n in range(most + 1):
        for bits in itertools.combinations(range(low, high), n):
            m = sum(1 << (BITS - 1 - b) for b in bits)
            out.append((m - (1 << 64) if m >> 63 else m, n))
    return out


def _prefixed(df: DataFrame, low: int, high: int, radius: int) -> DataFrame:
    """Rows (fp, z, used) with flips among bits low..high-1 made in z, where ``radius`` allows them."""
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("n")) for m, n in _masks(low, high, radius)])
    dealt = df.select("fp", "z", "used", F.explode(F.filter(flips, lambda x: x["n"] + F.col("used") <= radius)).alias("flip"))
    return dealt.select("fp", F.col("z").bitwiseXOR(F.col("flip.m")).alias("z"), (F.col("used") + F.col("flip.n")).alias("used"))


def _left(bits: int, used, radius: int):
    """How many variants a row that has used some flips still makes among ``bits`` bits."""
    return F.element_at(F.array(*[F.lit(sum(math.comb(bits, i) for i in range(radius - u + 1))).cast("long") for u in range(radius + 1)]), used + 1)


def _meetings(prefix: int, radius: int):
    masks = {u: np.array([m for m, _ in _masks(prefix, BITS, radius - u)], np.int64).view(np.uint64) for u in range(radius + 1)}

    def f(table: pa.Table) -> pa.Table:
        release()
        fp, z, used = (table[c].to_numpy() for c in ("fp", "z", "used"))
        nodes, at = np.unique(fp, return_inverse=True)
        keys, owner = [], []
        for u, m in masks.items():
            own = np.flatnonzero(used == u)
            keys.append((z[own].view(np.uint64)[:, None] ^ m).ravel())
            owner.append(np.repeat(at[own].astype(np.int32), len(m)))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        bits = nodes.view(np.uint64)
        same = same[np.bitwise_count(bits[owner[same]] ^ bits[owner[same + 1]]) <= 2 * radius]
        labels = bottom(np.arange(len(nodes)), owner[same], owner[same + 1])
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        return pa.table({"a": nodes[labels[moved]], "b": nodes[moved]})

    return f


def links(fps: DataFrame, radius: int = RADIUS, task_variants: int = TASK_VARIANTS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within ``radius`` bits (even) of each other."""
    half, spark = radius // 2, fps.sparkSession
    n = fps.count()
    whole = sum(math.comb(BITS, i) for i in range(half + 1))
    high = min(BITS - 8, max(4, math.ceil(math.log2(max(1, n * whole / task_variants))) + 1))
    dealt = _prefixed(fps.select("fp", F.col("fp").alias("z"), F.lit(0).alias("used")), 0, high, half)
    found, level = None, 0
    while True:
        level += 1
        key = F.shiftright("z", BITS - high) if high < BITS else F.col("z")
        dealt = dealt.withColumn("prefix", key)
        crowded = None
        if high < BITS:
            sums = dealt.groupBy("prefix").agg(F.sum(_left(BITS - high, F.col("used"), half)).alias("makes"), F.count(F.lit(1)).alias("rows"))
            crowded = written(sums.filter((F.col("makes") > 2 * task_variants) & (F.col("rows") > 1)).select("prefix"), "crowded")
            if crowded.isEmpty():
                crowded = None
        here = dealt.join(crowded, "prefix", "left_anti") if crowded is not None else dealt
        met = here.groupBy("prefix").applyInArrow(_meetings(high, half), "a long, b long")
        found = met if found is None else found.unionByName(met)
        if crowded is None:
            break
        further = min(BITS, high + _STEP)
        dealt = written(_prefixed(dealt.join(crowded, "prefix", "left_semi"), high, further, half), "dealt")
        high = further
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row, with the least id reachable over links of fingerprints.

    A null text has fingerprint zero, linked like any other. Equal fingerprints are one class, joined to the rest by
    its fingerprint; copies are never expanded into pairs. A null id belongs to its class but never names it: a class
    of null ids only has a null component_id. Repeated rows give repeated rows; an empty table gives none.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes"), radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """``classes`` (fp, least) with root, the least fingerprint of each one's group."""
    roots = components(links(classes.select("fp"), radius))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of linked fingerprints: the one of least id, nulls last, and of those the one of least hash.

    Groups are told by their fingerprints, so two groups that hold one id, or no ids at all, keep a row each. Of
    repeated rows one is kept. A row is found again by its id and a 64-bit hash of all its columns; an empty table
    gives none.
    """
    rows = written(fingerprints(docs, id_col, text_col, row_hash=True), "fingerprints")
    repeats = rows.groupBy("fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n")).alias("least")
    rooted = _rooted(written(repeats.groupBy("fp").agg(least), "classes"), radius)
    first = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.row").alias("_row"), F.col("least.n").alias("_n")), "first")
    all_ = docs.withColumns({"_own": F.col(f"`{id_col}`").cast("long"), "_hash": _row_hash(docs)}).hint("merge")  # rows grow with the documents: never broadcast
    same = (F.col("_hash") == F.col("_row")) & F.col("_own").eqNullSafe(F.col("_id"))
    kept = all_.join(first.filter("_n = 1"), same, "left_semi")
    repeated = first.filter("_n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(all_.join(repeated, same, "left_semi").dropDuplicates(["_own", "_hash"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
