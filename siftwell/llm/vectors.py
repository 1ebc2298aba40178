"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine t or more are within squared distance 2 - 2t. They are rotated and split into blocks; each
block has a share of that budget in proportion to its dimensions, so two near vectors are within the share in one
block at least. Each block is range-joined by itself. A grid over its leading coordinates, twice as wide as the
share's radius, brings together the vectors of a cell (its own) and those of half of the cells around that come within
the radius of it (guests). There, bitmaps of the rows below some marks on each coordinate give the pairs that can be within
the radius on all coordinates of the block; only their distances are computed. The union of what is within a block's share is verified
by the whole vectors' cosine in double precision. A pair counts in the first block that has it within its share, so no
pair is counted twice and none has to be written out.

Equal vectors are one class with a count. A cell of very many classes is split by the block's next coordinates, and
where those are used up (a crowd of near copies) into tiles of parts that are held against each other.

A vector goes to many cells, the more of them the larger the table. So cells and tiles are dealt to rounds of bounded
size: each reads the classes, sends the vectors of its own cells only, and its shuffle files go before the next begins.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import bottom, dropped, new_folder, written

COSINE = 0.93
BLOCKS = 4
#: Coordinates of a block that a level of the grid is over.
LEAD = 2
#: Classes of one cell, and guests, that one task holds against each other.
TILE = 16_384
#: Vectors that a round sends, for each class, and where that is fewer.
SENT, SENT_LEAST = 2, 250_000
#: Marks on a coordinate between its least and its greatest value.
STEPS = 64
_ROWS, _COLUMNS = 512, 4096  # that are held against each other at once
_DENSE = 1 / 2  # share of pairs from which a matrix product is cheaper than pair by pair
_NEAR = 1e-9  # figures from matrix products that are this near a bound are computed again, pair by pair


@functools.cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, blocks: int = BLOCKS) -> list[slice]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def turned(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; each row the same to the last bit, whatever the others are (a matrix product isn't)."""
    return np.einsum("ij,jk->ik", unit(x), rotation(x.shape[1]), optimize=False)


def budget(part: slice, dim: int, cosine: float) -> float:
    return max((2 - 2 * cosine) * (part.stop - part.start) / dim * (1 + 1e-9), 1e-18)


def _stack(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_KEY = ["label", "dim", "block", "path"]
_DEALT = [*_KEY, "guest", "gap", "cid", "embedding", "n"]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.int32()))


def _around(axes: int) -> list[tuple[int, ...]]:
    return list(itertools.product((0, -1, 1), repeat=axes))


def _spread(x: np.ndarray, guest: np.ndarray, gap: np.ndarray, most: float) -> list[np.ndarray]:
    """Row, cell, guest and gap of all places that rows have on one level of the grid, with its coordinates ``x``."""
    width = 2 * most**0.5
    cell = np.floor(x / width).astype(np.int64)
    below, above = x - cell * width, (cell + 1) * width - x
    out = []
    for step in _around(x.shape[1]):
        far = gap + sum(np.where(s < 0, below[:, i], above[:, i]) ** 2 * (s != 0) for i, s in enumerate(step))
        own = not any(step)
        half = own or next(s for s in step if s) > 0
        to = np.flatnonzero((far <= most * (1 + 1e-9)) & (guest | half))
        out.append((to, cell[to] + np.array(step), guest[to] | (not own), far[to]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _dealt(cosine: float, blocks: int, lead: int):
    """From rows without a path or in a cell that is too large to rows in the cells of the next coordinates.

    One level, with the vectors; ``_sent`` goes down all levels by places. An own row stays own in its cell and is a
    guest in half of those around; a guest is one in all cells around. Both only where the cell is within the radius,
    the coordinates of earlier levels (``gap``) included.
    """

    def one(b: pa.RecordBatch, dim: int, k: int) -> pa.RecordBatch:
        part = split(dim, blocks)[k]
        path = np.asarray(b.column("path").flatten()).reshape(b.num_rows, -1)
        x = turned(_stack(b.column("embedding")))[:, part]
        to, cell, guest, gap = _spread(x[:, path.shape[1] : path.shape[1] + lead], np.asarray(b.column("guest")), np.asarray(b.column("gap")), budget(part, dim, cosine))
        rows = b.take(pa.array(to))
        columns = {c: rows.column(c) for c in ("label", "dim", "cid", "embedding", "n")}
        columns |= {"block": pa.array(np.full(len(to), k), pa.int32()), "path": _lists(np.c_[path[to], cell].astype(np.int32)), "guest": pa.array(guest), "gap": pa.array(gap)}
        return pa.RecordBatch.from_arrays([columns[c] for c in _DEALT], _DEALT)

    def f(batches):
        for b in batches:
            for dim, k in sorted(set(zip(b.column("dim").to_pylist(), b.column("block").to_pylist(), strict=True))):
                own = b.filter(pc.and_(pc.equal(b.column("dim"), dim), pc.equal(b.column("block"), k)))
                for level in sorted(set(pc.list_value_length(own.column("path")).to_pylist())):
                    yield one(own.filter(pc.equal(pc.list_value_length(own.column("path")), level)), dim, k)

    return f


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(1)


def _within(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which rows of a and b are within a squared distance, the same whatever else is in a and b."""
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    out = d <= most
    i, j = np.nonzero(np.abs(d - most) < _NEAR)
    if len(i):
        out[i, j] = _squares(a[i], b[j]) <= most
    return out


class _Bitmaps:
    """Which rows are near which on each coordinate by itself: bitmaps of the rows below each of ``STEPS`` marks."""

    def __init__(self, x: np.ndarray, radius: float) -> None:
        least = x.min(0)
        scale = STEPS / np.maximum(x.max(0) - least, 1e-300)
        mark = lambda y: np.clip(np.floor((y - least) * scale), 0, STEPS).astype(np.int64)  # noqa: E731  rises with y
        radius *= 1 + 1e-9
        self.mark, self.low, self.high = mark(x), mark(x - radius), mark(x + radius) + 1

    def below(self, b: np.ndarray) -> list[np.ndarray]:
        return [np.packbits(m < np.arange(STEPS + 2)[:, None], axis=1) for m in self.mark[b].T]

    def near(self, a: np.ndarray, below: list[np.ndarray]) -> np.ndarray:
        """For each row of ``a`` a bitmap of those rows whose marks are within its radius on all coordinates."""
        both = None
        for c, bits in enumerate(below):
            got = bits[self.high[a, c]] ^ bits[self.low[a, c]]
            both = got if both is None else np.bitwise_and(both, got, out=both)
        return both


def _ones(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each one."""
    flat = bits.ravel()
    at = np.flatnonzero(flat)
    k, bit = np.nonzero(np.unpackbits(flat[at][:, None], axis=1))
    row, byte = np.divmod(at[k], bits.shape[1])
    return row, byte * 8 + bit


def _cosines(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows, in turn, have the cosine; near the bound it is that of the vectors as they are."""
    s = np.einsum("ij,ij->i", a, b)
    out = s >= cosine
    for k in np.flatnonzero(np.abs(s - cosine) < _NEAR):
        x, y = raw_a[k], raw_b[k]
        out[k] = float(x @ y) / (float(x @ x) ** 0.5 * float(y @ y) ** 0.5) >= cosine
    return out


def _linked(cosine: float, blocks: int):
    def f(table: pa.Table) -> pa.Table:
        return linked(table, cosine, blocks)[0]

    return f


def linked(table: pa.Table, cosine: float, blocks: int) -> tuple[pa.Table, int]:
    """The links of a cell or tile: cid, the least cid it is linked with here, its links; and the distances computed.

    Own rows are held against each other if ``i = j``, and against all guests.
    """
    raw = _stack(table["embedding"])
    dim, block = raw.shape[1], table["block"][0].as_py()
    turn, parts, plain = turned(raw), split(dim, blocks), unit(raw)
    most = [budget(p, dim, cosine) for p in parts]
    inside = [np.ascontiguousarray(turn[:, p]) for p in parts[: block + 1]]

    def sparse(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(_squares(inside[block][x], inside[block][y]) <= most[block])
        x, y = x[near], y[near]
        good = _cosines(plain[x], plain[y], raw[x], raw[y], cosine)
        for k in range(block):
            good &= _squares(inside[k][x], inside[k][y]) > most[k]
        return near[good]

    def dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = _within(inside[block][a], inside[block][b], most[block])
        s = plain[a] @ plain[b].T
        close = np.abs(s - cosine) < _NEAR
        good &= (s >= cosine) | close
        for k in range(block):
            good &= ~_within(inside[k][a], inside[k][b], most[k])
        i, j = np.nonzero(good & close)
        good[i, j] = _cosines(plain[a[i]], plain[b[j]], raw[a[i]], raw[b[j]], cosine)
        return good

    n, guest = table["n"].to_numpy(), table["guest"].to_numpy()
    own, others = np.flatnonzero(~guest), np.flatnonzero(guest)
    within = table["i"][0].as_py() == table["j"][0].as_py()
    all_ = np.r_[own, others] if within else others
    bitmaps = _Bitmaps(inside[block], most[block] ** 0.5)
    links, labels, compared = np.zeros(len(raw), np.int64), np.arange(len(raw)), 0
    for j in range(0, len(all_), _COLUMNS):
        b = all_[j : j + _COLUMNS]
        below = bitmaps.below(b)
        for i in range(0, min(len(own), j + _COLUMNS) if within and j < len(own) else len(own), _ROWS):
            a = own[i : i + _ROWS]
            bits = bitmaps.near(a, below)
            count = int(np.bitwise_count(bits).sum())
            if count > _DENSE * len(a) * len(b):
                count = len(a) * len(b)
                some = np.nonzero(dense(a, b))
                checked = True
            else:
                some, checked = _ones(bits), False
            p, q = some
            if within:  # each pair of own rows once, none with itself
                once = i + p < j + q
                p, q = p[once], q[once]
            compared += count if checked else len(p)
            for k in range(0, len(p), 1 << 16):
                x, y = a[p[k : k + (1 << 16)]], b[q[k : k + (1 << 16)]]
                if not checked:
                    good = sparse(x, y)
                    x, y = x[good], y[good]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                labels = bottom(labels, x, y)
    some = np.flatnonzero(links)
    cid = table["cid"].to_numpy()
    return pa.table({"cid": cid[some], "root": cid[labels[some]], "links": links[some]}), compared


def _mixed(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.asarray(x, np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _found(h: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are among sorted ones, and where."""
    at = np.searchsorted(among, h)
    if not len(among):
        return np.zeros(len(h), bool), at
    at = np.minimum(at, len(among) - 1)
    return among[at] == h, at


def _places(x: np.ndarray, h: np.ndarray, most: float, lead: int, crowded: np.ndarray):
    """Row, path, guest and hash of all cells that aren't ``crowded`` (sorted hashes of those to be split), by levels.

    Only what is decided for a cell goes by its hash: cells of one hash would be split or tiled alike, never mixed.
    """
    n = len(x)
    row, path, guest, gap = np.arange(n), np.zeros((n, 0), np.int64), np.zeros(n, bool), np.zeros(n)
    while len(row):
        level = path.shape[1]
        at, cell, guest, gap = _spread(x[row, level : level + lead], guest, gap, most)
        row, path, h = row[at], np.c_[path[at], cell], h[at]
        for c in cell.T:
            h = _mixed(h, c)
        more = _found(h, crowded)[0] & (path.shape[1] < x.shape[1])
        yield row[~more], path[~more], guest[~more], h[~more]
        row, path, guest, gap, h = row[more], path[more], guest[more], gap[more], h[more]


def _parted(b: pa.RecordBatch, blocks: list[int], cosine: float, count: int, lead: int, crowded: np.ndarray):
    """For some rows of one length and each block: dim, block, number of the first row, and what ``_places`` gives."""
    dims = pc.list_value_length(b.column("embedding"))
    for dim in pc.unique(dims).to_pylist():
        some = np.flatnonzero(np.asarray(pc.equal(dims, dim)))
        own = b.take(pa.array(some))
        plain, parts = unit(_stack(own.column("embedding"))), split(dim, count)
        seed = own.column("seed").to_numpy().view(np.uint64)
        for k in (k for k in blocks if k < len(parts)):
            x = np.einsum("ij,jk->ik", plain, np.ascontiguousarray(rotation(dim)[:, parts[k]]), optimize=False)  # as in turned()
            for row, *rest in _places(x, _mixed(seed, k), budget(parts[k], dim, cosine), lead, crowded):
                yield dim, k, some[row], *rest


_BATCH = 4096
_COUNTED = "block int, cell long, spent boolean, own long, rows long"
_SENT = [*_KEY, "guest", "cid", "embedding", "n", "i", "j"]


def _slices(batches):
    for b in batches:
        for start in range(0, b.num_rows, _BATCH):
            yield b.slice(start, _BATCH)


def _counted(cosine: float, count: int, lead: int, crowded: np.ndarray):
    """From classes to the rows of each cell; ``spent`` says that the block has no coordinates left to split it by."""

    def f(batches):
        for b in _slices(batches):
            for dim, k, _, path, guest, h in _parted(b, list(range(count)), cosine, count, lead, crowded):
                cells, at = np.unique(h, return_inverse=True)
                rows, own = np.bincount(at, minlength=len(cells)), np.bincount(at[~guest], minlength=len(cells))
                spent = path.shape[1] >= dim // min(count, dim)  # coordinates of the smallest block
                columns = [pa.array(np.full(len(cells), k), pa.int32()), pa.array(cells.view(np.int64)), pa.array(np.full(len(cells), spent)), pa.array(own), pa.array(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "cell", "spent", "own", "rows"])

    return f


def _tiles(guest: np.ndarray, h: np.ndarray, cid: np.ndarray, tiled: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Index, guest, i, j and hash of all places: a row of a tiled cell (hashes, parts of own rows, parts of guests)
    goes to a tile i <= j for each part that its own is held against, as a guest where its part is the second."""
    yes, at = _found(h, tiled[0])
    plain, some = np.flatnonzero(~yes), np.flatnonzero(yes)
    zero = np.zeros(len(plain), np.int64)
    out = [(plain, guest[plain], zero, zero)]
    if len(some):
        to, more, g = tiled[1][at[some]], tiled[2][at[some]], guest[some]
        spread = _mixed(cid[some].view(np.uint64), 1)
        part = np.where(g, to + (spread % np.maximum(more, 1).astype(np.uint64)).astype(np.int64), (spread % to.astype(np.uint64)).astype(np.int64))
        times = np.where(g, to, to + more)
        which = np.repeat(np.arange(len(some)), times)
        other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        part, g = part[which], g[which]
        out.append((some[which], g | (other < part), np.minimum(part, other), np.maximum(part, other)))
    k, g, i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return [k, g, i, j, _mixed(_mixed(h[k], i + 1), j + 1)]


def _sent(cosine: float, count: int, lead: int, crowded: np.ndarray, tiled: tuple, blocks: list[int], turn: int, turns: int):
    """From classes to the rows of those cells and tiles of some blocks whose turn it is."""

    def f(batches):
        for b in _slices(batches):
            cid = b.column("cid").to_numpy()
            for dim, k, row, path, guest, h in _parted(b, blocks, cosine, count, lead, crowded):
                place, guest, i, j, h = _tiles(guest, h, cid[row], tiled)
                now = np.flatnonzero(h % np.uint64(turns) == turn)
                for at in range(0, len(now), 4 * _BATCH):
                    t = now[at : at + 4 * _BATCH]
                    rows = b.take(pa.array(row[place[t]]))
                    columns = {c: rows.column(c) for c in ("label", "cid", "embedding", "n")}
                    columns |= {c: pa.array(np.full(len(t), v), pa.int32()) for c, v in (("dim", dim), ("block", k))}
                    columns |= {"path": _lists(path[place[t]].astype(np.int32)), "guest": pa.array(guest[t]), "i": pa.array(i[t].astype(np.int32)), "j": pa.array(j[t].astype(np.int32))}
                    yield pa.RecordBatch.from_arrays([columns[c] for c in _SENT], _SENT)

    return f


def _cells(classes: DataFrame, cosine: float, count: int, lead: int, tile: int) -> tuple[np.ndarray, tuple, dict[int, int]]:
    """The cells to be split, those to be tiled with their numbers of parts, and the vectors to be sent for each block.

    Only crowded cells reach the driver, at most one for each ``tile`` vectors sent.
    """
    crowded = np.zeros(0, np.uint64)
    while True:
        sizes = classes.mapInArrow(_counted(cosine, count, lead, crowded), _COUNTED).groupBy("block", "cell", "spent").agg(F.sum("own").alias("own"), F.sum("rows").alias("rows"))
        large = (F.col("own") > 0) & (F.greatest(F.col("own"), F.col("rows") - F.col("own")) > tile)
        found = sizes.groupBy("block").agg(F.sum(F.when(~large, F.col("rows"))).alias("rest"), F.collect_list(F.when(large, F.struct("cell", "spent", "own", "rows"))).alias("large")).collect()
        cells = [(r["block"], *c) for r in found for c in r["large"]]
        new = np.array([cell for _, cell, spent, _, _ in cells if not spent], np.int64).view(np.uint64)
        if not len(new):
            break
        crowded = np.union1d(crowded, new)
    total = {r["block"]: r["rest"] or 0 for r in found}
    tiles = {}
    for block, cell, _, own, rows in cells:
        to, more = -(-own // tile), -(-(rows - own) // tile)
        tiles[cell] = (to, more)
        total[block] += own * (to + more) + (rows - own) * to
    keys = np.array(list(tiles), np.int64).view(np.uint64)
    order, parts = np.argsort(keys), np.array(list(tiles.values()), np.int64).reshape(-1, 2)
    return crowded, (keys[order], parts[order, 0], parts[order, 1]), total


def _rounds(total: dict[int, int], classes: int) -> list[tuple[list[int], int, int]]:
    """Blocks, turn and number of turns of each round."""
    most = max(SENT * classes, SENT_LEAST)
    if sum(total.values()) <= most:
        return [(sorted(total), 0, 1)]
    return [([k], turn, turns) for k in sorted(total) for turns in [-(-total[k] // most)] for turn in range(turns)]


def _all_links(classes: DataFrame, cosine: float, count: int, lead: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(cid, links) and (node, root) of the classes that have links.

    Every few rounds their rows, one for each place with a link, are summed up to a row a class.
    """
    crowded, tiled, total = _cells(classes, cosine, count, lead, tile)
    spark, rounds, sums = classes.sparkSession, _rounds(total, classes.count()), None
    for at in range(0, len(rounds), _SUMMED):
        folders = []
        for blocks, turn, turns in rounds[at : at + _SUMMED]:
            sent = classes.mapInArrow(_sent(cosine, count, lead, crowded, tiled, blocks, turn, turns), _sent_schema(classes))
            folders.append(new_folder(spark, "linked"))
            written(sent.groupBy(*_KEY, "i", "j").applyInArrow(_linked(cosine, count), _LINKS), "linked", clean=True, path=folders[-1])
        links = spark.read.schema(_LINKS).parquet(*folders)
        edges = links.select(F.col("root").alias("a"), F.col("cid").alias("b"))
        links = links.select("cid", "links")
        if sums:
            links, edges = links.unionByName(sums[0]), edges.unionByName(sums[1].select(F.col("root").alias("a"), F.col("node").alias("b")))
        sums = links.groupBy("cid").agg(F.sum("links").alias("links")), components(edges)
        if at + _SUMMED < len(rounds):
            sums = written(sums[0], "counts", clean=True), sums[1]
            dropped(spark, folders)
    return sums


_LINKS = "cid long, root long, links long"
#: Rounds after which their rows are summed up.
_SUMMED = 4


def _sent_schema(classes: DataFrame) -> T.StructType:
    kinds = {"path": T.ArrayType(T.IntegerType()), "guest": T.BooleanType(), "dim": T.IntegerType(), "block": T.IntegerType(), "i": T.IntegerType(), "j": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c) or classes.schema[c].dataType) for c in _SENT])


def _mark():
    """Column: what a vector is found again by, if no two classes of a label have the same."""
    return F.xxhash64("embedding")


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, lead: int = LEAD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors link if their labels are equal and not null and their cosine is ``cosine`` or more. A vector that is null,
    empty or zero, or holds a null or a number that isn't finite, links with nothing, and so does one without an id;
    vectors of different lengths never link. Rows of one id are vectors of their own, and count as links of each other
    if they are near. An empty table gives an empty one; other columns are dropped.
    """
    if lead < 1:
        raise ValueError("a level of the grid is over one coordinate at least")
    kind = "float" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull) else "double"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("embedding"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(usable, F.lit(False))
    seed, mark = F.xxhash64("label", F.size("embedding")), _mark()
    grouped = rows.filter(usable).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = written(grouped.select("*", seed.alias("seed"), mark.alias("mark"), F.monotonically_increasing_id().alias("cid")), "classes", clean=True)
    counts, roots = _all_links(classes.select("label", "seed", "cid", "embedding", "n"), cosine, blocks, lead, tile)
    alone = classes.groupBy("label", "mark").count().filter("count > 1").isEmpty()
    key = ["label", "mark"] if alone else ["label", "mark", "embedding"]  # vectors are sent only if hashes don't tell all of them apart
    rooted = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", *key, "n", "least", F.coalesce("root", "cid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").join(counts, "cid", "left").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    some, none = rows.filter(usable), rows.filter(~usable)
    same = some.withColumn("mark", mark).select("vec_id", *key).join(of, key).select("vec_id", "n_links", "component_id")
    every = same.unionByName(none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a
"""
