"""Evaluation passages inside a corpus: SimHash of sliding windows, multi-index Hamming search, exact verification.

Items and documents are read as the same windows of consecutive units (words,
or letters and digits for items of scripts without blanks). Every window gets
a 64-bit SimHash. The items' fingerprints are cut into radius + 1 blocks; two
fingerprints within the radius agree on at least one block, so looking up the
documents' windows block by block finds all of them. Candidates are verified by
the weighted Jaccard similarity of the windows' shingles, at 1 by equality of
the units in order.

Two settings are queries: windows of the size of the shortest passage that
counts, compared exactly, and windows of the items' own sizes, compared by the
weighted Jaccard similarity of their shingles.

Items are searched in slices of bounded size, each sent to all tasks; the
corpus streams past all of them once, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.llm.text import hashed_words, mix, runs

#: Windows of one slice of items (about 100 MB in a task at the most).
SLICE_WINDOWS = 1_000_000
SLICE_ITEMS = 5_000
STEP = 65_536
SIZE_STEP = 1.08  # ratio of neighbouring sizes of windows
#: Languages whose items are compared by letters and digits.
LETTER_LANGS = ("zh", "ja")
_LETTER = re.compile(r"[^\W_]")
_WIDE = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
U = np.uint64


def hashed_letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the letters and digits of each text."""
    flat: list[np.ndarray] = []
    off = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        s = "".join(_LETTER.findall(t.lower())) if t else ""
        flat.append(np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(U))
        off[i + 1] = off[i] + len(s)
    return mix(np.concatenate(flat) + U(0x9E3779B9)) if off[-1] else np.zeros(0, U), off


def simhash(units: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every run of n units: each bit is the majority of the units' bits."""
    m = len(units) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for a in range(0, m, STEP):
        part = units[a : min(a + STEP, m) + n - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k = len(part) - n + 1
        total = np.zeros((k, 64), np.uint16 if n > 255 else np.uint8)
        for i in range(n):
            total += bits[i : i + k]
        out[a : a + k] = np.packbits(total * 2 > n if n <= 127 else total > n // 2, axis=1, bitorder="little").view(U).ravel()
    return out


def windows(units: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first unit, SimHash, hash of the units in order) of every window inside a text."""
    exact, doc = runs(units, off, n)
    size = np.maximum(np.diff(off) - n + 1, 0)
    first = np.repeat(off[:-1], size) + (np.arange(len(exact)) - np.repeat(np.cumsum(size) - size, size))
    return doc, first, simhash(units, n)[first] if len(exact) else np.zeros(0, U), exact


class HammingIndex:
    """Fingerprints looked up by blocks; finds every one within the radius."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            mask = U((1 << int(b - a)) - 1)
            key = ((prints >> U(a)) & mask).astype(np.int64)
            order = np.argsort(key, kind="stable")
            short = b - a <= 20
            # short blocks are looked up by address, long ones by search
            begin = np.append(0, np.cumsum(np.bincount(key, minlength=1 << int(b - a)))).astype(np.int32) if short else key[order]
            self.blocks.append((U(a), mask, short, begin, order))

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, print number) of all pairs within the radius, once each."""
        qs, ps = [], []
        for shift, mask, short, begin, order in self.blocks:
            v = ((q >> shift) & mask).astype(np.int64)
            lo, hi = (begin[v], begin[v + 1]) if short else (np.searchsorted(begin, v), np.searchsorted(begin, v, side="right"))
            n = hi - lo
            hit = np.flatnonzero(n)
            who = np.repeat(hit, n[hit])
            at = np.repeat(lo[hit] - (np.cumsum(n[hit]) - n[hit]), n[hit]) + np.arange(len(who))
            p = order[at]
            near = np.bitwise_count(q[who] ^ self.prints[p]) <= self.radius
            qs.append(who[near])
            ps.append(p[near])
        pair = np.unique(np.concatenate(qs) * max(len(self.prints), 1) + np.concatenate(ps))
        return pair // max(len(self.prints), 1), pair % max(len(self.prints), 1)


class ItemIndex:
    """Windows of one slice of items in one unit."""

    def __init__(self, ids: list, texts: list[str], n: int, letters: bool, radius: int) -> None:
        self.n, self.letters = n, letters
        self.units, off = hashed_letters(texts) if letters else hashed_words(texts)
        doc, self.first, prints, self.exact = windows(self.units, off, n)
        self.item = np.array(ids, np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        self.search = HammingIndex(prints, radius).search if len(prints) else None
        # no window lacks a CJK letter, so documents without one hold none of them
        self.wide = letters and all(len(run) < n for t in texts for run in _WIDE.split("".join(_LETTER.findall((t or "").lower()))))
        # weight of a unit: the rarer among the items, the heavier
        values, counts = np.unique(self.units, return_counts=True)
        self.values, self.weights = values, np.log(1 + len(self.units) / counts)

    def weight(self, u: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, u), len(self.values) - 1)
        return np.where(self.values[at] == u, self.weights[at], np.log(1 + len(self.units)))

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two windows' pairs of neighbouring units."""
        wa, wb = self.weight(a), self.weight(b)
        pa_, pb = mix(a[:-1] * U(3) + a[1:]), mix(b[:-1] * U(3) + b[1:])
        sa = dict(zip(pa_.tolist(), (wa[:-1] + wa[1:]).tolist()))
        sb = dict(zip(pb.tolist(), (wb[:-1] + wb[1:]).tolist()))
        both = sum(w for k, w in sa.items() if k in sb)
        every = sum(sa.values()) + sum(w for k, w in sb.items() if k not in sa)
        return both / every if every else 0.0

    def find(self, texts: list[str | None], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item id, similarity) per verified pair of windows."""
        if self.wide and least >= 1:
            texts = [t if t and _WIDE.search(t) else None for t in texts]
        units, off = hashed_letters(texts) if self.letters else hashed_words(texts)
        doc, first, prints, exact = windows(units, off, self.n)
        if not len(doc) or self.search is None:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        q, p = self.search(prints)
        same = exact[q] == self.exact[p]
        sim = same.astype(float)
        if least < 1:
            for i in np.flatnonzero(~same):
                sim[i] = self.similarity(units[first[q[i]] : first[q[i]] + self.n], self.units[self.first[p[i]] : self.first[p[i]] + self.n])
        ok = sim >= least
        return doc[q[ok]], self.item[p[ok]], sim[ok]


class SizedIndex:
    """Items by their own sizes: each is looked up in windows of about its number of units.

    Sizes fall into classes SIZE_STEP apart. A SimHash sums the units' bits,
    weighted by their rarity among the items, over the whole window; it is kept
    as running sums, so a window costs the same at every size.
    """

    def __init__(self, ids: list, texts: list[str], shingle: int, letters: bool, radius: int) -> None:
        self.shingle, self.letters = shingle, letters
        units, off = hashed_letters(texts) if letters else hashed_words(texts)
        values, counts = np.unique(units, return_counts=True)
        self.values, self.top = values, int(np.clip(np.log(1 + len(units)) * 4, 1, 60))
        self.weights = np.clip(np.log(1 + len(units) / np.maximum(counts, 1)) * 4, 1, 60).astype(np.int32)
        self.items = [(i, units[a:b]) for i, a, b in zip(ids, off, off[1:]) if b - a >= shingle]
        classes: dict[int, list[int]] = {}
        for k, (_, u) in enumerate(self.items):
            classes.setdefault(int(np.log(len(u)) / np.log(SIZE_STEP)), []).append(k)
        self.classes = []
        for rows in classes.values():
            n = int(np.median([len(self.items[k][1]) for k in rows]))
            prints = np.array([self.prints(self.items[k][1], [len(self.items[k][1])])[len(self.items[k][1])][0] for k in rows], U)
            self.classes.append((n, np.array(rows), HammingIndex(prints, radius).search))

    def weight(self, u: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.ones(len(u), np.int32)
        at = np.minimum(np.searchsorted(self.values, u), len(self.values) - 1)
        return np.where(self.values[at] == u, self.weights[at], self.top).astype(np.int32)

    def prints(self, units: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        """Weighted SimHashes of every run of n units, for each of the sizes n: all read off the same running sums."""
        out = {n: np.zeros(max(len(units) - n + 1, 0), U) for n in sizes}
        w = self.weight(units)
        most = max(sizes, default=1)
        for a in range(0, len(units), STEP):
            part = slice(a, min(a + STEP + most - 1, len(units)))
            bits = np.unpackbits(units[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
            total = np.zeros((len(bits) + 1, 64), np.int32)
            np.cumsum((2 * bits - 1) * w[part, None], axis=0, out=total[1:])
            for n in sizes:
                k = min(STEP, len(bits) - n + 1)
                if k > 0:
                    out[n][a : a + k] = np.packbits(total[n : n + k] > total[:k], axis=1, bitorder="little").view(U).ravel()
        return out

    def shingles(self, u: np.ndarray) -> dict[int, int]:
        h, _ = runs(u, np.array([0, len(u)]), self.shingle)
        w = self.weight(u)
        sums = np.convolve(w, np.ones(self.shingle, np.int32), "valid")
        return dict(zip(h.tolist(), sums.tolist()))

    def find(self, texts: list[str | None], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item id, similarity) per verified window and item."""
        units, off = hashed_letters(texts) if self.letters else hashed_words(texts)
        doc_of = np.repeat(np.arange(len(texts)), np.diff(off))
        docs, ids, sims = [], [], []
        every_print = self.prints(units, sorted({n for n, _, _ in self.classes}))
        for n, rows, search in self.classes:
            p = every_print[n]
            inside = np.flatnonzero(doc_of[: len(p)] == doc_of[n - 1 :]) if len(p) else np.zeros(0, np.int64)
            q, hit = search(p[inside]) if len(inside) else (np.zeros(0, np.int64),) * 2
            for start, k in zip(inside[q], rows[hit]):
                i, u = self.items[k]
                d = doc_of[start]
                b = self.shingles(units[start : min(start + len(u), off[d + 1])])
                a = self.shingles(u)
                both = sum(w for x, w in a.items() if x in b)
                every = sum(a.values()) + sum(w for x, w in b.items() if x not in a)
                if every and both >= least * every:
                    docs.append(d)
                    ids.append(i)
                    sims.append(both / every)
        return np.array(docs, np.int64), np.array(ids, np.int64), np.array(sims, float)


def _search(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, lang: str, make: Callable[[list, list[str], bool], ItemIndex | SizedIndex], least: float) -> DataFrame:
    """Stream the documents past the items, one bounded slice of items after another, each sent to all tasks."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.lower(F.trim(lang)).alias("l"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    slices = max(1, -(-wanted.count() // SLICE_ITEMS))
    indexes = []
    for s in range(slices):
        rows = wanted.where(F.pmod(F.xxhash64("i", "l", "t"), F.lit(slices)) == s).collect()
        for wide in (False, True):
            part = [r for r in rows if (r["l"] in LETTER_LANGS) == wide]
            # a slice of very long items is cut further, so an index stays within its bound
            while part:
                size, k = 0, 0
                while k < len(part) and (k == 0 or size + len(part[k]["t"]) <= SLICE_WINDOWS):
                    size += len(part[k]["t"])
                    k += 1
                indexes.append(spark.sparkContext.broadcast(make([r["i"] for r in part[:k]], [r["t"] for r in part[:k]], wide)))
                part = part[k:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                c = b.slice(a, 1000)
                texts = c.column(1).to_pylist()
                for ix in indexes:
                    doc, item, sim = ix.value.find(texts, least)
                    yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(sim, pa.float64())], names=["d", "i", "s"])

    found = src.mapInArrow(run, "d long, i long, s double")
    return found.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.count("*").alias("windows"), F.max("s").alias("similarity"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang", words: int = 13, letters: int = 25, radius: int = 3, least: float = 1.0) -> DataFrame:
    """(doc_id, item_id, windows, similarity): documents that hold passages of an item.

    A passage is a window of ``words`` words (``letters`` letters and digits
    for items whose lang is zh or ja) whose SimHash is within ``radius`` of an
    item's window and whose similarity to it is at least ``least``; 1 asks for
    the same units in the same order. ``windows`` counts matching pairs of
    windows, ``similarity`` is the best. Items and documents with NULL or
    shorter texts match nothing. Ids must be whole numbers. Rows repeating a
    document id count together; other columns are ignored.
    """
    return _search(docs, items, doc_id, item_id, text, lang, lambda ids, texts, wide: ItemIndex(ids, texts, letters if wide else words, wide, radius), least)


def similar_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang", shingle: int = 5, radius: int = 10, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, windows, similarity): documents that hold an item as a whole, edited here and there.

    Windows have the item's own size; those whose weighted SimHash is within
    ``radius`` of the item's are compared by the weighted Jaccard similarity of
    their runs of ``shingle`` words (letters for zh and ja). Items of fewer
    units match nothing, nor do documents shorter than the item. NULLs, repeats
    and other columns as in ``leaks``.
    """
    return _search(docs, items, doc_id, item_id, text, lang, lambda ids, texts, wide: SizedIndex(ids, texts, shingle, wide, radius), least)
