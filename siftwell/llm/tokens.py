"""Token ids and counts of whole texts, by pieces that the library encodes alone.

A text is cut where the tokenizer's own pre-tokenizer must cut it (white space, and simple punctuation after a word
of Latin letters), so the ids of the pieces, in a row, are the ids of the text. Strings of the vocabulary that the
library itself encodes alone as one token are proven once for each worker; other pieces go through the library's
merges once and are then remembered. A text with white space other than space, tab and line ends, or with the string
of a special token, goes to the library as a whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing, kept, release, utf8

LIMIT = 512
#: Pieces that a worker remembers besides the vocabulary, about 170 bytes each as measured.
REMEMBERED = 800_000
FREQUENT = 16_384

_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u206f\u3000\ufeff]")
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SPACED = re.compile(rf" ?[{_LETTERS}]+(?=[ \n\t\r,.;:!?]|\Z)|[,.;:!?]+(?=[ \n\t\r]|\Z)| ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
# Characters of which it is plain what they are; of a piece of them alone, the pre-tokens follow.
_PLAIN = re.compile(rf" ?[!-~{_LETTERS}]+")
_PRE_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+")
_PRE_BARE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_BARE = re.compile(r"[^ \n\t\r]+")


def _alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


_BYTES = str.maketrans(dict(enumerate(_alphabet())))


class _Places(dict):
    """A piece's place in the table of ids; a new piece gets the next place and waits for the library."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        return place


class _Frequent(dict):
    """The places of the most frequent pieces, in a table that stays in the processor's cache; the rest are in ``all``."""

    def __init__(self, all_: _Places, known=()) -> None:
        super().__init__(known)
        self.all = all_

    def __missing__(self, piece: str) -> int:
        return self.all[piece]


class Encoder:
    """Ids as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        self.cut = {"ByteLevel": _SPACED, "Sequence": _BARE}.get(kind)
        self.divide = str.split if kind == "Sequence" else _SPACED.findall  # a plain text has no other white space
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = kind == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and not spec.get("normalizer") or kind == "Sequence" and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if not known or spec["model"]["type"] != "BPE" or spec.get("post_processor"):
            self.cut = None
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.lower = kind == "Sequence"
        self.remembered = remembered
        self.places = _Places()
        self.frequent, self.seen = _Frequent(self.places), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.offset, self.length, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.single = self._proven() if self.cut else 0

    def _proven(self) -> int:
        """Fill the table with the strings of the vocabulary that the library encodes alone as one token."""
        ids = list(range(self.library.get_vocab_size()))
        strings = [s for s in self.library.decode_batch([[i] for i in ids], skip_special_tokens=False) if s and "�" not in s]
        strings = [s for s in dict.fromkeys(strings) if self.cut.fullmatch(s) and not _ODD.search(s) and not (self.special and self.special.search(s))]
        for s, e in zip(strings, self.library.encode_batch(strings, add_special_tokens=False), strict=True):
            if len(e.ids) == 1:
                self.places[s]
        self._learn()
        return self.filled

    def _learn(self) -> None:
        new = self.places.new
        for i in range(0, len(new), 50_000):
            ids = self._merged(new[i : i + 50_000])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
            while self.filled + len(ids) > len(self.offset):
                self.offset, self.length = (np.r_[x, np.zeros_like(x)] for x in (self.offset, self.length))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
            at = slice(self.filled, self.filled + len(ids))
            self.length[at] = sizes
            self.offset[at] = self.used + np.cumsum(sizes) - sizes
            self.used, self.filled = self.used + total, self.filled + len(ids)
        new.clear()

    def _merged(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece: by its model's merges alone where the pre-tokens are plain, else by all its steps."""
        out: list = [None] * len(pieces)
        merge, cut = self.library.model.tokenize, (_PRE_BARE if self.lower else _PRE_SPACED).findall
        plain = [i for i, m in enumerate(map(_PLAIN.fullmatch, pieces)) if m]
        whole = "\n".join([pieces[i] for i in plain])
        whole = whole.lower() if self.lower else whole
        pre = [cut(p) for p in whole.split("\n")] if plain else []
        marked = iter("\n".join(chain.from_iterable(pre)).encode().decode("latin-1").translate(_BYTES).split(_BYTES[10]))
        for i, p in zip(plain, pre, strict=True):
            out[i] = [t.id for _ in p for t in merge(next(marked))]
        mixed = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(mixed, self.library.encode_batch([pieces[i] for i in mixed], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _forget(self) -> None:
        if len(self.places) > self.remembered + self.single:
            keep = self.single + self.remembered // 4
            while len(self.places) > keep:  # in place, the newest first: a copy would need both at once
                self.places.popitem()
            self.filled = keep
            self.frequent, self.seen = _Frequent(self.places), 0
            self.used = int(self.offset[keep - 1] + self.length[keep - 1])
            release(0, keep=True)

    def _places_of(self, texts: list[str | None]) -> tuple[list[np.ndarray | None], list]:
        """Places of each text's pieces, or None and the whole text's ids from the library."""
        self._forget()
        out, whole = [], []
        collects = gc.isenabled()
        gc.disable()  # many short-lived lists and no cycles
        try:
            self._look_up(texts, out, whole)
            self._learn()
        finally:
            if collects:
                gc.enable()
        if self.seen < 2:
            self._count_frequent([p for p in out if p is not None])
        return out, whole

    def _look_up(self, texts: list[str | None], out: list, whole: list) -> None:
        place = self.frequent.__getitem__
        for t in texts:
            if t and (self.cut is None or _ODD.search(t) or self.special and self.special.search(t)):
                out.append(None)
                whole.append(self.library.encode(t, add_special_tokens=False).ids)
            else:
                out.append(np.fromiter(map(place, self.divide(t)), np.int64) if t else np.zeros(0, np.int64))
                whole.append(None)

    def _count_frequent(self, places: list[np.ndarray]) -> None:
        """Twice for each worker: note which pieces of this group of texts are the most frequent."""
        counts = np.bincount(np.concatenate(places), minlength=self.filled) if places else np.zeros(0, np.int64)
        if counts.sum() < 100_000:
            return
        best = set(np.argpartition(-counts, min(FREQUENT, len(counts) - 1))[:FREQUENT].tolist())
        self.frequent = _Frequent(self.places, {k: v for k, v in self.places.items() if v in best})
        self.seen += 1

    def count(self, texts: list[str | None]) -> np.ndarray:
        places, whole = self._places_of(texts)
        return np.array([int(self.length[p].sum()) if p is not None else len(w) for p, w in zip(places, whole, strict=True)], np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        places, whole = self._places_of(texts)
        out = []
        for p, w in zip(places, whole, strict=True):
            if p is None:
                out.append(np.array(w, np.int32))
                continue
            sizes = self.length[p]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.offset[p] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker, kept from task to task until a stage of another kind begins."""
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def groups(texts: pa.Array, most: int = 4 << 20):
    """Bounds of runs of rows with about ``most`` bytes of text, one row at least."""
    _, bounds = utf8(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text, under the vocabulary file at ``path``.

    ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece, without begin, end or added special
    tokens. A null text counts as empty; null ids, repeated rows and empty tables pass through as they are.
    """

    def f(batches):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: np.array([len(x) for x in model.encode([t or "" for t in texts], num_threads=1)], np.int64)
        else:
            count = encoder(path).count
        for b in batches:
            _, bounds = utf8(b.column(1))
            n = np.concatenate([np.zeros(0, np.int64), *(count(b.column(1)[i:j].to_pylist()) for i, j in groups(b.column(1)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(freeing(f, keep=True), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
