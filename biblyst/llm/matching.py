"""Matching records of two sources without a common key.

1. Records, their attributes and the tokens in them form a graph. Random walks
   go from a record to tokens of its attributes, through a token to another
   record that holds it, and on to tokens of that record.
2. Skip-gram vectors with negative sampling are trained on the walks. A token's
   vector is the mean of hashed character trigrams and of the whole token, so
   slips in writing move it little and the model has a fixed size. Tasks train
   on their own walks; the results are averaged.
3. Blocking: hyperplanes hash two vectors of every record, that of its title
   (weighted by inverse frequency; short titles with the words of their
   journal) and that of the title's first HEAD words, which a cut-off end leaves
   alone. A right record probes the codes that differ in the bits nearest to
   their planes. The number of bits grows with the records that share a group of
   years, the number of tables follows from the recall wanted at a given angle.
   A join on equal identifiers adds pairs without titles in common.
4. Candidates are reranked by exact comparison of all attributes. A logistic
   model of the cosine and the compared attributes, but not the identifier, is
   calibrated on pairs whose identifiers decide; its score is the confidence.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblyst.llm.heavy import heavy_hitters
from biblyst.llm.names import edits
from biblyst.session import materialize, small

BUCKETS, DIM = 1 << 14, 64
FREQUENT = 1e-3
TRAIN_TASKS, TRAIN_ROWS = 16, 200_000
WALK, WINDOW, NEGATIVES, RATE = 4, 1, 64, 0.05
BATCH = 32_768  # pairs of a training step
SLICES = 64  # of a model on its way
#: Words of a title's head, and titles of fewer words than SHORT are hashed with their journal.
HEAD, SHORT = 6, 5
#: Codes a right record looks up in a table, and the bits nearest to their planes among which they differ.
PROBES, NEAREST = 16, 8
#: (angle in degrees, part of pairs at that angle that all tables may miss) for whole titles and for heads.
WHOLE_RECALL, HEAD_RECALL = (35, 0.03), (15, 0.03)
LEAST_BITS, GROUP_BITS = 10, 17  # beyond GROUP_BITS the first bits of a code split the group
PER = 4  # tables a task searches together
YEARS, YEAR_GROUPS = 3, 16  # years in a group of years; groups are taken modulo YEAR_GROUPS
YEAR_SLACK = 2
NO_YEAR = -(1 << 14)
#: Left records of one identifier that one task holds against its right ones.
COPIED = 200
#: Right records on whose likeliest labelled pairs the confidence is fitted.
CALIBRATION_ROWS = 50_000
DAMPING = 1e-2
#: Confidence from which a possible pair is a match.
ACCEPT = 0.5
#: Weights of the confidence where nothing is labelled: cosine, the features of ``compare``, offset.
DEFAULT_WEIGHTS = (4.0, 3.0, 3.0, -4.0, 1.0, -3.0, -0.5, -1.0, -3.0)
#: Records on which the centre of the hashed vectors is fitted.
CENTRE_SAMPLE = 20_000
U = np.uint64

_TAG = re.compile(r"<[^>]+>|\[[^\]]*\]")
_WORD = re.compile(r"[^\W_]+")
# Words that carry no meaning in names of journals.
SMALL = frozenset("of in and the on for & online".split())


@lru_cache(20_000)
def title_words(t: str | None) -> tuple[str, ...]:
    if not t:
        return ()
    return tuple(_WORD.findall(_TAG.sub(" ", html.unescape(t)).lower().replace("&", " and ")))


def journal_words(c: Column) -> Column:
    """First three letters of the meaningful words, separated by blanks: alike for a name and its abbreviations."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~w.isin(*sorted(SMALL)))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 3)), " ")


def bare_doi(c: Column) -> Column:
    """Lower-case identifier without resolver, prefix and closing signs, or NULL."""
    x = F.regexp_extract(F.replace(F.lower(c), F.lit("%2f"), F.lit("/")), r"10\.\d{4,9}/\S+", 0)
    x = F.regexp_replace(x, r"[^a-z0-9)]+$", "")
    return F.when(x != "", x)


@lru_cache(50_000)
def _grams(token: str) -> tuple[int, ...]:
    p = f"<{token}>"
    return tuple(xxhash.xxh32_intdigest(g) & (BUCKETS - 1) for g in {p, *(p[i : i + 3] for i in range(len(p) - 2))})


@lru_cache(100_000)
def token_id(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


def tokens(title: str | None, year: int | None, journal: str | None, doi: str | None) -> list[str]:
    """Token nodes of a record; the attribute is part of the node except for title words. ``journal`` as made by journal_words."""
    out = list(title_words(title))
    if year is not None and year == year:
        out.append(f"year:{int(year)}")
    out += [f"journal:{w}" for w in (journal or "").split()]
    if doi:
        out.append(f"doi:{doi}")
    return out


def start_model() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(3)
    return g.standard_normal((BUCKETS, DIM)).astype(np.float32) / math.sqrt(DIM), np.zeros((BUCKETS, DIM), np.float32)


def train(walks: list[list[str]], model: tuple[np.ndarray, np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram with negative sampling over walks; negatives are shared within a batch."""
    e, c = model
    g = np.random.default_rng(seed)
    known: dict[str, int] = {}
    flat = [[known.setdefault(t, len(known)) for t in w] for w in walks]
    grams = [_grams(t) for t in known]
    out_of = np.array([x[0] for x in (tuple([xxhash.xxh32_intdigest(t, 1) & (BUCKETS - 1)]) for t in known)], np.int64)
    left, right = [], []
    for w in flat:
        for i, a in enumerate(w):
            for b in w[max(0, i - WINDOW) : i + WINDOW + 1]:
                if a != b:
                    left.append(a)
                    right.append(b)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    order = g.permutation(len(left))
    left, right = left[order], right[order]
    size = np.array([len(x) for x in grams])
    start = np.append(0, np.cumsum(size))
    gram = np.array([x for y in grams for x in y], np.int64)
    for a in range(0, len(left), BATCH):
        lo, ro = left[a : a + BATCH], right[a : a + BATCH]
        u, inv = np.unique(lo, return_inverse=True)
        n = size[u]
        rows = gram[np.repeat(start[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.cumsum(n) - n
        v = np.add.reduceat(e[rows], at, axis=0) / n[:, None]
        x, ctx = v[inv], out_of[ro]
        neg = out_of[g.choice(right, NEGATIVES)]
        pos = 1 / (1 + np.exp(-np.clip((x * c[ctx]).sum(1), -8, 8))) - 1
        low = 1 / (1 + np.exp(-np.clip(x @ c[neg].T, -8, 8))) * (5 / NEGATIVES)
        grad = pos[:, None] * c[ctx] + low @ c[neg]
        order = np.argsort(ctx, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(ctx[order]) != 0))
        step = np.add.reduceat((pos[:, None] * x)[order], cut, axis=0)
        c[ctx[order][cut]] -= RATE * np.clip(step, -1, 1)
        np.add.at(c, neg, -RATE * np.clip(low.T @ x / len(lo) * NEGATIVES, -1, 1))
        per = np.zeros_like(v)
        order = np.argsort(inv, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(inv[order]) != 0))
        per[inv[order][cut]] = np.add.reduceat(grad[order], cut, axis=0)
        wide = np.repeat(np.clip(per, -1, 1) / n[:, None], n, axis=0)
        order = np.argsort(rows, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
        e[rows[order][cut]] -= RATE * np.clip(np.add.reduceat(wide[order], cut, axis=0), -1, 1)
    return e, c


@lru_cache(50_000)
def _trigram_bit(g: str) -> int:
    return 1 << (xxhash.xxh32_intdigest(g) & 255)


def trigram_mask(words: tuple[str, ...]) -> bytes:
    """256 bits of the title's trigrams: slips change few of them, another word many."""
    t = f" {' '.join(words)} "
    m = 0
    for i in range(len(t) - 2):
        m |= _trigram_bit(t[i : i + 3])
    return m.to_bytes(32, "little")


class Encoder:
    """Vectors of records from the trained model and token weights."""

    def __init__(self, e: np.ndarray, values: np.ndarray, counts: np.ndarray, rows: int) -> None:
        self.e = e
        top = math.log(1 / FREQUENT)
        self.weight = {int(v): float(np.clip(math.log(max(rows, 1) / n) / top, 0.05, 1)) for v, n in zip(values, counts)}
        self.mean = np.zeros((2, DIM), np.float32)  # of whole titles and of heads

    def vectors(self, lists: list) -> np.ndarray:
        """Sums of the weighted unit vectors of each record's tokens."""
        known: dict[str, int] = {}
        flat = np.array([known.setdefault(t, len(known)) for ts in lists for t in ts], np.int64)
        x = np.zeros((len(lists), DIM), np.float32)
        if not len(flat):
            return x
        grams = [_grams(t) for t in known]
        at = np.append(0, np.cumsum([len(g) for g in grams]))[:-1]
        v = np.add.reduceat(self.e[np.array([i for g in grams for i in g], np.int64)], at, axis=0)
        v *= (np.array([self.weight.get(token_id(t), 1.0) for t in known]) / (np.linalg.norm(v, axis=1) + 1e-9)).astype(np.float32)[:, None]
        size = np.array([len(ts) for ts in lists])
        some = np.flatnonzero(size)
        x[some] = np.add.reduceat(v[flat], np.append(0, np.cumsum(size[some]))[:-1], axis=0)
        return x

    def cosines(self, a: list[list[str]], b: list[list[str]]) -> np.ndarray:
        """Cosine of each pair of records, computed together."""
        x, y = self.vectors(a) - self.mean[0], self.vectors(b) - self.mean[0]
        return (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1) + 1e-9)


def title_relation(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, float]:
    """(kind, covered part of the longer title): same, part (one lies in the other), other (words differ), none."""
    if not a or not b:
        return "none", 0.0
    if a == b:
        return "same", 1.0
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    size = min(sum(map(len, a)), sum(map(len, b)))
    if min(sum(map(len, left)), sum(map(len, right))) > 0.6 * size:
        return "other", 1 - max(sum(map(len, left)), sum(map(len, right))) / max(sum(map(len, a)), sum(map(len, b)))
    # slips, and words cut off at the end
    for w in list(left):
        for v in right:
            # numbers are no slips of each other
            d = edits(w, v) if w.isalpha() and v.isalpha() else 9
            if (d <= 2 and min(len(w), len(v)) >= 4 and max(len(w), len(v)) >= 5) or (d <= 1 and max(len(w), len(v)) >= 2) or (len(v) < len(w) and v == b[-1] and w.startswith(v)) or (len(w) < len(v) and w == a[-1] and v.startswith(w)):
                left.remove(w)
                right.remove(v)
                break
    if left and right:
        # words run together or cut apart
        x, y = "".join(left), "".join(right)
        if edits(x, y, 3) <= 3 and max(len(x), len(y)) >= 6 and sorted(filter(str.isdigit, x)) == sorted(filter(str.isdigit, y)):
            left, right = [], []
    longer, shorter = (len(a), len(b)) if len(a) >= len(b) else (len(b), len(a))
    covered = 1 - max(sum(map(len, left)), sum(map(len, right))) / max(sum(map(len, a)), sum(map(len, b)))
    if not left and not right:
        return "same", 1.0
    if left and right:
        small = min((left, right), key=lambda z: sum(map(len, z)))
        return ("part", covered) if sum(map(len, small)) <= 3 and covered >= 0.7 else ("other", covered)
    return ("part" if covered >= 0.35 and shorter >= 3 else "other"), covered


def compare(a: tuple, b: tuple, known: bool) -> tuple[float, bool, list[float]]:
    """(rank, possible, features) of two records (title, year, journal key, doi).

    ``known``: the right record's source is a journal of the left table. The
    features leave the identifier out.
    """
    wa, wb = title_words(a[0]), title_words(b[0])
    kind, covered = title_relation(wa, wb)
    equal = a[3] is not None and a[3] == b[3]
    differ = a[3] is not None and b[3] is not None and a[3] != b[3]
    gap = abs(a[1] - b[1]) if a[1] is not None and b[1] is not None else None
    ja, jb = a[2].split() if a[2] else [], b[2].split() if b[2] else []
    n = min(len(ja), len(jb))
    same = n > 0 and (ja == jb or (n >= 2 and ja[:n] == jb[:n] and abs(len(ja) - len(jb)) <= 1))
    # a journal of the corpus other than the article's own speaks against the pair; an unknown source doesn't
    against = n > 0 and not same and known
    generic = min(len(wa), len(wb)) < SHORT
    # the shorter title is the beginning of the longer one, but for its last word
    begins = kind == "part" and min(len(wa), len(wb)) >= SHORT and all(x == y for x, y in zip(wa[: len(wb) - 1], wb[: len(wa) - 1]))
    if gap is not None and gap > YEAR_SLACK:
        ok = False
    elif kind == "same":
        ok = equal or (same if generic else not against)
        if generic and not equal:
            ok = ok and gap is not None and gap <= 1 and not differ
    elif kind == "part":
        ok = equal or (not against and not generic and (same or begins or covered >= 0.75))
    else:
        ok = kind == "none" and equal and not against
    rank = 4 * equal + {"same": 3.0, "part": 2 * covered, "none": 0.0, "other": -4.0}[kind] + 1.5 * same - 2 * against - 0.5 * differ - 0.4 * (gap if gap is not None else 1)
    features = [float(kind == "same"), covered if kind == "part" else 0.0, float(kind == "other"), float(same), float(against), float(gap if gap is not None else 1), float(generic)]
    return rank, ok, features


def flip_patterns() -> np.ndarray:
    """(PROBES, NEAREST): which of the nearest bits a probe flips, by the expected cost of their distances to the planes."""
    every = [c for k in range(4) for c in combinations(range(NEAREST), k)]
    every.sort(key=lambda c: (sum((j + 1) * (j + 2) for j in c), c))
    out = np.zeros((PROBES, NEAREST), bool)
    for i, c in enumerate(every[:PROBES]):
        out[i, list(c)] = True
    return out


def hit_rate(bits: int, fixed: int, degrees: float) -> float:
    """Part of the pairs of vectors at an angle that one table brings together (drawn 20 000 times)."""
    g = np.random.default_rng(1)
    x = g.standard_normal((20_000, bits))
    y = math.cos(math.radians(degrees)) * x + math.sin(math.radians(degrees)) * g.standard_normal(x.shape)
    differ = (x > 0) != (y > 0)
    order = np.argsort(np.abs(y[:, fixed:]), axis=1)
    near = np.take_along_axis(differ[:, fixed:], order, 1)
    probed = (near[:, None, :NEAREST] == flip_patterns()[None]).all(2).any(1)
    return float((probed & ~near[:, NEAREST:].any(1) & ~differ[:, :fixed].any(1)).mean())


class Tables(NamedTuple):
    bits: int
    fixed: int  # leading bits that must agree
    whole: int
    head: int


def plan_tables(group: int) -> Tables:
    """Bits for groups of ``group`` left records, and tables enough for the recall wanted."""
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(group, 2)))), 30)
    fixed = max(0, bits - GROUP_BITS)
    count = [max(1, math.ceil(math.log(miss) / math.log(1 - min(hit_rate(bits, fixed, deg), 1 - 1e-9)))) for deg, miss in (WHOLE_RECALL, HEAD_RECALL)]
    return Tables(bits, fixed, *count)


def hashed_words_of(title: str | None, journal: str | None) -> tuple[list[str], list[str]]:
    """Tokens of the whole title (short ones with their journal's words) and of its head."""
    w = list(title_words(title))
    j = [f"journal:{x}" for x in journal.split()] if journal and 0 < len(w) < SHORT else []
    return w + j, w[:HEAD] + j


#: year, word mask, trigram mask of a record, and codes of PER tables; right records add their nearest bits.
LEFT = np.dtype([("year", "<i2"), ("words", "<u8"), ("tri", "<u8", (4,)), ("code", "<u4", (PER,))])
RIGHT = np.dtype([*LEFT.descr, ("near", "u1", (PER, NEAREST))])


def _route(enc, t: Tables):
    """(years, tables, first, side, rid, raw): a record for each group of years in which it may meet others and each set of tables."""
    planes = np.random.default_rng(17).standard_normal((DIM, (t.whole + t.head) * t.bits)).astype(np.float32)
    cut = t.whole * t.bits
    per = PER if not t.fixed else 1
    sets = [list(range(a, min(a + per, t.whole + t.head))) for a in range(0, t.whole + t.head, per)]
    weight = (1 << np.arange(t.bits - 1, -1, -1, dtype=np.int64)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = enc.value
        for b in batches:
            side, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            title, year, journal = (b.column(i).to_pylist() for i in (2, 3, 4))
            keep = np.array([i for i, x in enumerate(title) if title_words(x)], np.int64)
            if not len(keep):
                continue
            tok = [hashed_words_of(title[i], journal[i]) for i in keep]
            x = np.concatenate([(m.vectors([x[0] for x in tok]) - m.mean[0]) @ planes[:, :cut], (m.vectors([x[1] for x in tok]) - m.mean[1]) @ planes[:, cut:]], axis=1)
            x = x.reshape(len(keep), -1, t.bits)
            code = ((x > 0) * weight).sum(2, dtype=np.uint32)
            near = (t.bits - 1 - t.fixed - np.argsort(np.abs(x[:, :, t.fixed :]), axis=2)[:, :, :NEAREST]).astype(np.uint8)
            raw = np.zeros(len(keep), RIGHT)
            raw["year"] = [NO_YEAR if year[i] is None or abs(year[i]) > 9999 else year[i] for i in keep]
            raw["words"] = [sum({1 << (token_id(w) & 63) for w in title_words(title[i])}) for i in keep]
            raw["tri"] = np.frombuffer(b"".join(trigram_mask(title_words(title[i])) for i in keep), "<u8").reshape(-1, 4)
            right = side[keep] == 1
            g, s, f, who, out = [], [], [], [], []
            y = raw["year"].astype(np.int64)
            none = y == NO_YEAR
            # a left record lies in the group of its year, a right one is sent to all groups in reach
            own = np.where(none, YEAR_GROUPS, (y // YEARS) % YEAR_GROUPS)
            at = [(np.flatnonzero(~right), own[~right])]
            low, high = (y - YEAR_SLACK) // YEARS, (y + YEAR_SLACK) // YEARS
            dated = right & ~none
            at += [(np.flatnonzero(dated), low[dated] % YEAR_GROUPS)]
            for k in range(1, 1 + 2 * YEAR_SLACK // YEARS + 1):
                more = dated & (low + k <= high)
                at.append((np.flatnonzero(more), (low[more] + k) % YEAR_GROUPS))
            at.append((np.flatnonzero(dated), np.full(dated.sum(), YEAR_GROUPS)))
            at += [(np.flatnonzero(right & none), np.full((right & none).sum(), k)) for k in range(YEAR_GROUPS + 1)]
            rows = np.concatenate([i for i, _ in at])
            groups = np.concatenate([v for _, v in at])
            for n, part in enumerate(sets):
                raw["code"][:, : len(part)] = code[:, part]
                raw["near"][:, : len(part), : near.shape[2]] = near[:, part]
                first = (code[:, part[0]] >> np.uint32(t.bits - t.fixed)).astype(np.int32) if t.fixed else np.zeros(len(keep), np.int32)
                bare = np.zeros(len(keep), LEFT)
                for name in LEFT.names:
                    bare[name] = raw[name]
                made = np.empty(len(keep), object)
                made[right] = [r.tobytes() for r in raw[right]]
                made[~right] = [r.tobytes() for r in bare[~right]]
                g.append(groups)
                s.append(np.full(len(rows), n))
                f.append(first[rows])
                who.append(keep[rows])
                out.append(made[rows])
            who = np.concatenate(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(g), pa.int32()), pa.array(np.concatenate(s), pa.int32()), pa.array(np.concatenate(f), pa.int32()), pa.array(side[who], pa.int32()), pa.array(rid[who], pa.int64()), pa.array(np.concatenate(out).tolist(), pa.binary())],
                names=["years", "tables", "first", "side", "rid", "raw"],
            )

    return run


def alike(a: np.ndarray, b: np.ndarray, part: float, least: int) -> np.ndarray:
    """Whether the mask with fewer bits lacks at most ``least`` + ``part`` of them in the other one, row by row."""
    both, na, nb = (np.bitwise_count(x).sum(1, dtype=np.int32) if x.ndim > 1 else np.bitwise_count(x).astype(np.int32) for x in (a & b, a, b))
    few = np.minimum(na, nb)
    return few - both <= least + (few * part)


def _probe(t: Tables):
    """Candidate pairs of rows sorted by (years, tables, first, side): left records first, then right ones, which probe their tables."""
    per = PER if not t.fixed else 1
    n_tables = t.whole + t.head
    flips = flip_patterns()
    mask = np.uint32((1 << (t.bits - t.fixed)) - 1)
    size = 1 << (t.bits - t.fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        lr = np.zeros(0, np.int64)
        left = np.zeros(0, LEFT)
        tables: list[tuple] = []
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in range(4)])
            rids = b.column(4).to_numpy()
            raws = b.column(5).to_pylist()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if b.num_rows else []
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, e in zip(cut, [*cut[1:], b.num_rows]):
                k = tuple(keys[a][:3])
                if k != key:
                    key, held, tables = k, [], []
                if keys[a][3] == 0:
                    held.append((rids[a:e], np.frombuffer(b"".join(raws[a:e]), LEFT)))
                    continue
                if not held:
                    continue
                here = min(per, n_tables - int(k[1]) * per)
                if not tables:
                    lr, left = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    for j in range(here):
                        c = (left["code"][:, j] & mask).astype(np.int64)
                        o = np.argsort(c, kind="stable")
                        # where each code begins: a lookup by address, not by search
                        begin = np.append(0, np.cumsum(np.bincount(c, minlength=size))).astype(np.int32)
                        # years and word masks stand in the table's order: most pairs end there
                        tables.append((begin, o.astype(np.int32), left["year"][o], left["words"][o]))
                q = np.frombuffer(b"".join(raws[a:e]), RIGHT)
                q_year, q_words, q_tri = q["year"].astype(np.int32), np.ascontiguousarray(q["words"]), np.ascontiguousarray(q["tri"])
                for j, (begin, order, years, words) in enumerate(tables):
                    code = (q["code"][:, j] & mask).astype(np.int64)
                    bit = np.int64(1) << q["near"][:, j].astype(np.int64)
                    for pattern in flips:
                        v = code ^ (bit[:, pattern].sum(1) if pattern.any() else 0)
                        lo = begin[v]
                        n = begin[v + 1] - lo
                        hit = np.flatnonzero(n)
                        if not len(hit):
                            continue
                        # large buckets are met in pieces, so memory stays bounded
                        ends = np.cumsum(n[hit], dtype=np.int64)
                        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 4_000_000)), len(hit)))
                        for x, y in zip(cuts, cuts[1:]):
                            h = hit[x:y]
                            who = np.repeat(h, n[h])
                            at = np.repeat(lo[h] - (np.cumsum(n[h]) - n[h]), n[h]) + np.arange(len(who))
                            ok = alike(q_words[who], words[at], 0.4, 1)
                            who, at = who[ok], at[ok]
                            this, that = q_year[who], years[at].astype(np.int32)
                            ok = (np.abs(this - that) <= YEAR_SLACK) | (this == NO_YEAR) | (that == NO_YEAR)
                            who, at = who[ok], order[at[ok]]
                            ok = alike(q_tri[who], left["tri"][at], 0.25, 2)
                            out_a.append(lr[at[ok]])
                            out_b.append(rids[a:e][who[ok]])
            pair = np.unique(np.column_stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return run


def calibrate(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve, the last one its offset, that turns features into confidences (Newton's method, slightly damped)."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + DAMPING * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - labels) + DAMPING * w)
    return w


def match_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, cosine, confidence): each right record with the one left record it describes, if any.

    Both tables: (id string, title, year, journal, doi), any of which but id
    may be NULL. A left record may have several right ones. Repeated ids count
    once (their smallest row). Records that agree in all attributes are compared
    once; of several such left records the one with the largest id is taken.
    Records without title can only meet by an equal identifier. Other columns
    are ignored.
    """
    spark = left.sparkSession
    sc = spark.sparkContext
    attributes = ["title", "year", "journal", "doi"]

    def one(df: DataFrame, side: int) -> DataFrame:
        cols = [F.col("title").cast("string").alias("title"), F.col("year").cast("int").alias("year"), F.col("journal").cast("string").alias("journal"), F.col("doi").cast("string").alias("doi")]
        df = df.select(F.col("id"), *cols).where("id is not null").groupBy("id").agg(F.min(F.struct(*attributes)).alias("r"))
        return df.select(F.lit(side).alias("side"), "id", "r.*")

    alike_key = F.md5(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}))
    both = materialize(one(left, 0).unionByName(one(right, 1)).withColumn("k", alike_key), "both")
    # records alike in everything are compared once: groups of copies are never paired
    records = both.groupBy("side", "k").agg(F.max("id").alias("id"), *[F.first(c).alias(c) for c in attributes])
    records = records.withColumns({"rid": F.xxhash64("id", "side"), "journal": journal_words(F.col("journal")), "doi": bare_doi(F.col("doi"))})
    records = materialize(records.select("side", "rid", "id", *attributes, "k"), "records")

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rid": pdf["rid"], "tok": [sorted({token_id(t) for t in tokens(*r)}) for r in zip(pdf["title"], pdf["year"].astype(object).where(pdf["year"].notna(), None), pdf["journal"], pdf["doi"])]})

    toks = materialize(records.select("rid", *attributes).mapInPandas(ids, "rid long, tok array<long>"), "tokens")
    values, counts, rows = heavy_hitters(toks, "tok", FREQUENT)
    heavy = sc.broadcast(frozenset(values.tolist()))

    def doors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Two tokens per record through which a walk may leave it: frequent ones lead anywhere and are left out."""
        for pdf in batches:
            rows_ = [(int(r), int(t)) for r, ts in zip(pdf["rid"], pdf["tok"]) for t in sorted((t for t in map(int, ts) if t not in heavy.value), key=lambda t: (t * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFF)[:2]]
            yield pd.DataFrame(rows_, columns=["rid", "door"]).astype("int64")

    edges = toks.mapInPandas(doors, "rid long, door long")
    hop = edges.withColumn("next", F.lead("rid").over(Window.partitionBy("door").orderBy(F.xxhash64("rid")))).where("next is not null").groupBy("rid").agg(F.min_by("next", F.xxhash64("next")).alias("next"))
    text = records.select("rid", *attributes)
    steps = text.join(hop, "rid", "left").join(text.toDF("next", "title2", "year2", "journal2", "doi2"), "next", "left").drop("next")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, c = start_model()
        seen = 0
        for n, pdf in enumerate(batches):
            g = np.random.default_rng(n)
            pdf = pdf.astype(object).where(pdf.notna(), None)
            walks = []
            for r in pdf.itertuples(index=False):
                first, second = tokens(*r[1:5]), tokens(*r[5:9])
                walk = [first[i] for i in g.permutation(len(first))[:WALK]] if first else []
                walks.append(walk + ([second[i] for i in g.permutation(len(second))[:WALK]] if second else []))
            if any(len(w) > 1 for w in walks):
                e, c = train(walks, (e, c), n)
            seen += len(walks)
        if seen:
            yield pd.DataFrame({"slice": np.arange(SLICES), "n": seen, "v": [x.tobytes() for x in np.split(e, SLICES)]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        v = sum(np.frombuffer(x, np.float32) * k for x, k in zip(pdf["v"], n)) / n.sum()
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "v": [v.astype(np.float32).tobytes()]})

    # a task for TRAIN_ROWS records, so the models that travel stay a small part of the input
    parts = steps.repartition(max(TRAIN_TASKS, -(-rows // TRAIN_ROWS)), "rid").mapInPandas(learn, "slice int, n long, v binary")
    e = start_model()[0]
    for r in parts.groupBy("slice").applyInPandas(average, "slice int, v binary").collect():  # one model
        e[r["slice"] * (BUCKETS // SLICES) : (r["slice"] + 1) * (BUCKETS // SLICES)] = np.frombuffer(r["v"], np.float32).reshape(-1, DIM)
    enc = Encoder(e, values, counts, rows)
    bare = sc.broadcast(enc)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok = [hashed_words_of(t, j) for t, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for k in (0, 1):
                x = bare.value.vectors([t[k] for t in tok])
                yield pa.RecordBatch.from_arrays([pa.array([k] * DIM, pa.int32()), pa.array(np.arange(DIM), pa.int32()), pa.array(x.sum(0).astype(float), pa.float64()), pa.array([len(x)] * DIM, pa.int64())], names=["k", "i", "s", "n"])

    # the centres of the hashed vectors, like the planes, are fitted on a sample; all records are hashed
    part = int(min(1.0, CENTRE_SAMPLE / max(rows, 1)) * (1 << 30))
    mean = records.where(F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(1 << 30)) < part).select("title", "journal").mapInArrow(centre, "k int, i int, s double, n long").groupBy("k", "i").agg((F.sum("s") / F.sum("n")).alias("m")).toPandas()
    enc.mean[mean["k"].to_numpy(int), mean["i"].to_numpy(int)] = mean["m"].fillna(0).to_numpy(np.float32)
    full = sc.broadcast(enc)
    group = F.when(F.col("year").isNull(), YEAR_GROUPS).otherwise(F.pmod(F.floor(F.col("year") / YEARS), F.lit(YEAR_GROUPS)))
    sizes = records.where("side = 0").groupBy(group.alias("g")).count().agg(F.max("count")).first()[0]  # YEAR_GROUPS + 1 rows
    t = plan_tables(sizes or 0)
    sent = records.select("side", "rid", "title", "year", "journal").mapInArrow(_route(full, t), "years int, tables int, first int, side int, rid long, raw binary")
    key = ["years", "tables", "first"]
    found = sent.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side").mapInArrow(_probe(t), "a long, b long").distinct()
    # a plain join of equal identifiers, for pairs that their titles do not bring together
    keyed = records.where("doi is not null").select("side", "rid", "doi", F.col("year").cast("long").alias("year"))
    # the left records of an identifier copied about are split, and each part meets copies of the right ones
    owners = keyed.where("side = 0").groupBy("doi").agg((1 + F.count("*") / COPIED).cast("int").alias("parts"))
    ours = keyed.where("side = 0").join(owners, "doi").select("doi", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), F.col("rid").alias("a"), F.col("year").alias("year_a"))
    theirs = keyed.where("side = 1").join(owners, "doi").select("doi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rid").alias("b"), F.col("year").alias("year_b"))
    # years too far apart are never possible in ``compare``
    by_doi = ours.join(theirs, ["doi", "part"]).where(f"year_a is null or year_b is null or abs(year_a - year_b) <= {YEAR_SLACK}").select("a", "b")
    pairs = materialize(found.withColumn("near", F.lit(True)).unionByName(by_doi.withColumn("near", F.lit(False))).groupBy("a", "b").agg(F.max("near").alias("near")), "pairs")
    names = records.where("side = 0 and journal <> ''").select("journal").distinct().withColumn("known", F.lit(True))
    la = records.where("side = 0").select(F.col("rid").alias("a"), F.col("id").alias("left_id"), *[F.col(c).alias(f"{c}_a") for c in attributes])
    known = records.where("side = 1").select("journal").distinct().join(names, "journal").select("journal", "known")
    rb = records.where("side = 1").join(small(materialize(known, "journals")), "journal", "left")
    rb = rb.select(F.col("rid").alias("b"), F.col("id").alias("right_id"), *[F.col(c).alias(f"{c}_b") for c in attributes], F.coalesce("known", F.lit(False)).alias("known"))

    # right records drawn for the calibration are labelled with all their candidates, possible or not
    candidates = records.where("side = 1 and doi is not null").join(pairs.where("near").select(F.col("b").alias("rid")).distinct(), "rid", "left_semi").count()
    drawn = int(min(1.0, CALIBRATION_ROWS / max(candidates, 1)) * (1 << 32))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(12)]
            keep, rank, good, features, label = [], [], [], [], []
            for i in range(batch.num_rows):
                x, y = (c[1][i], c[2][i], c[3][i], c[4][i]), (c[6][i], c[7][i], c[8][i], c[9][i])
                r, ok, f = compare(x, y, c[10][i])
                # identifiers label the pairs that the titles alone brought together
                both_known = c[11][i] and x[3] is not None and y[3] is not None and xxhash.xxh32_intdigest(c[5][i]) < drawn
                if not ok and not both_known:
                    continue
                keep.append(i)
                rank.append(r)
                good.append(ok)
                features.append(f)
                label.append(int(x[3] == y[3]) if both_known else None)
            # the cosine leaves the identifier out as well
            cos = full.value.cosines([tokens(*(c[j][i] for j in range(1, 4)), None) for i in keep], [tokens(*(c[j][i] for j in range(6, 9)), None) for i in keep])
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(k), batch.column(5).take(k), pa.array(rank, pa.float64()), pa.array(good, pa.bool_()), pa.array(cos.astype(float), pa.float64()), pa.array(features, pa.list_(pa.float64())), pa.array(label, pa.int32())],
                names=["left_id", "right_id", "rank", "good", "cosine", "features", "label"],
            )

    order = ["left_id", "title_a", "year_a", "journal_a", "doi_a", "right_id", "title_b", "year_b", "journal_b", "doi_b", "known", "near"]
    scored = materialize(pairs.join(la, "a").join(rb, "b").select(*order).mapInArrow(rerank, "left_id string, right_id string, rank double, good boolean, cosine double, features array<double>, label int"), "scored")
    # the likeliest labelled pair of each right record: the confidence is that of a best candidate
    labelled = scored.where("label is not null").groupBy("right_id").agg(F.max_by(F.struct("cosine", "features", "label"), F.struct("cosine", "left_id")).alias("x"))
    drawn = labelled.select("x.*", F.xxhash64("right_id").alias("h")).orderBy("h").limit(CALIBRATION_ROWS).toPandas()
    if drawn["label"].nunique() == 2:
        w = calibrate(np.column_stack([drawn["cosine"].to_numpy(float), np.array(drawn["features"].tolist(), float)]), drawn["label"].to_numpy(float))
    else:
        w = np.array(DEFAULT_WEIGHTS)  # no labelled pairs to learn from
    score = F.lit(float(w[-1])) + F.col("cosine") * float(w[0])
    for i, x in enumerate(w[1:-1]):
        score = score + F.col("features")[i] * float(x)
    scored = scored.withColumn("confidence", 1 / (1 + F.exp(-score)))
    best = scored.where(F.col("good") & (F.col("confidence") >= ACCEPT)).groupBy("right_id").agg(F.max_by(F.struct("left_id", "cosine", "confidence"), F.struct("rank", "confidence", "left_id")).alias("x")).select("right_id", "x.*")
    # right records that are alike share the match of the one that was compared
    twins = both.where("side = 1").select("k", F.col("id").alias("twin")).join(records.where("side = 1").select("k", F.col("id").alias("right_id")), "k")
    return twins.join(best, "right_id").select("left_id", F.col("twin").alias("right_id"), "cosine", "confidence")
