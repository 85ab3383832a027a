"""Variant spellings of personal names, linked to a list of persons.

1. Names are folded and read as (surname, given name, middle initials), in both
   orders where no comma tells; equal readings collapse to one form.
2. Surnames of forms and persons become TF-IDF vectors of character trigrams;
   a distributed sparse top-n cosine join pairs them. The join is exact above
   its threshold: grams stand in one global order, rarest first, and two
   vectors of cosine t share a gram of the prefix after which less than t of
   their norm is left.
3. Forms and persons of a surname are grouped by average-linkage clustering of
   their given names; forms with mere initials go to the compatible group with
   the most occurrences.
4. A form is linked to all persons of its group. Where several groups are
   compatible, works that a person lists decide single author values.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize, small

COSINE, TOP = 0.42, 10
LINKAGE = 0.7
#: Left strings of one gram that one task holds against its right ones.
POSTINGS = 5000
#: A given name in more than 2/COMMON of all values is no slip of another one.
COMMON = 2000
#: Part of the occurrences of all compatible groups that the best group must hold for mere initials.
SHARE = 0.4

# Short forms of given names.
SHORT = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzy": "elizabeth",
    "becky": "rebecca", "nick": "nicholas", "ben": "benjamin", "tom": "thomas", "tommy": "thomas", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "jenny": "jennifer", "jen": "jennifer", "mike": "michael", "mick": "michael", "ted": "theodore", "theo": "theodore", "ed": "edward", "eddie": "edward", "ned": "edward", "andy": "andrew", "drew": "andrew",
    "chris": "christopher", "kit": "christopher", "sue": "susan", "susie": "susan", "trish": "patricia", "pat": "patricia", "patty": "patricia", "dan": "daniel", "danny": "daniel", "paco": "francisco", "pancho": "francisco",
    "pepe": "jose", "lupe": "guadalupe", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "sasha": "alexander", "alex": "alexander", "sandy": "alexander", "dick": "richard", "rick": "richard", "rich": "richard",
    "hannes": "johannes", "hans": "johannes", "beppe": "giuseppe", "peppe": "giuseppe", "fritz": "friedrich", "fred": "frederick", "sam": "samuel", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "joe": "joseph", "steve": "stephen", "dave": "david", "matt": "matthew", "tony": "anthony", "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "larry": "lawrence", "ron": "ronald", "tim": "timothy", "nacho": "ignacio",
    "kike": "enrique", "uli": "ulrich", "kathi": "katharina", "misha": "mikhail", "vanya": "ivan", "katya": "ekaterina", "lena": "elena", "debbie": "deborah", "barb": "barbara", "cathy": "catherine", "terry": "theresa",
}
# Short forms of more than one name.
SEVERAL = {"ted": ("theodore", "edward"), "alex": ("alexander", "alexandra"), "pat": ("patricia", "patrick"), "sam": ("samuel", "samantha"), "chris": ("christopher", "christine"), "sasha": ("alexander", "alexandra")}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "’": "", "'": "", "`": ""})
_TITLE = re.compile(r"\b(?:prof|dr|phd|mr|mrs|ms|sir|jr|sr|iii|ii|iv)\b\.?")


@lru_cache(50_000)
def fold(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(_LETTERS)) if not unicodedata.combining(c))
    return re.sub("(?<=[aou])e(?=[^\\W\\d_])", "", s)  # written-out umlauts, alike on both sides


def _given(words: list[str]) -> tuple[str, str]:
    """(given name or initial, initials of the others)."""
    parts = []
    for w in words:
        w = w.strip(".-")
        if not w:
            continue
        bits = [b for b in re.split(r"[.\-]+", w) if b]
        if all(len(b) == 1 for b in bits):
            parts += bits
        else:
            parts.append("-".join(bits))
    return (parts[0], "".join(p[0] for p in parts[1:])) if parts else ("", "")


@lru_cache(50_000)
def readings(name: str) -> tuple[tuple[str, str, str], ...]:
    """(surname, given, middle initials) of a name, in each order it may stand in."""
    s = re.sub(r'"[^"]*"', " ", fold(name))
    s = _TITLE.sub(" ", s)
    s = re.sub(r"[^\w\s,.\-]", " ", s)
    if "," in s:
        cells = [c.split() for c in s.split(",") if c.strip(" .")]
        if len(cells) > 1:
            return (("".join(cells[0]).strip(".-"), *_given(cells[1])),)
        s = " ".join(cells[0]) if cells else ""
    words = [w for w in re.sub(r"\.(?=\w)", ". ", s).split() if w.strip(".-")]
    if len(words) < 2:
        return ()
    out = []
    if len(words) > 2 and min(len(words[-1]), len(words[-2])) > 3:
        out.append((f"{words[-2]}-{words[-1]}", *_given(words[:-2])))  # a double surname without its hyphen
    if len(words[-1].strip(".-")) > 1:
        out.append((words[-1].strip(".-"), *_given(words[:-1])))
    if len(words[0].strip(".-")) > 1:
        out.append((words[0].strip(".-"), *_given(words[1:])))
    return tuple(out)


@lru_cache(200_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, change, swap neighbours) from a to b, or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@lru_cache(200_000)
def given_similarity(a: str, b: str) -> float:
    """1 for the same name or its short form, 0.9 for a slip in writing, else 0."""
    if a == b:
        return 1.0
    for x in SEVERAL.get(a, (SHORT.get(a, a),)):
        for y in SEVERAL.get(b, (SHORT.get(b, b),)):
            if x == y:
                return 1.0
            if min(len(x), len(y)) >= 3 and edits(x, y) <= (1 if min(len(x), len(y)) < 7 else 2) and (x[0] == y[0] or x[:2] == y[1::-1] or edits(x, y) == 1):
                return 0.9
    return 0.0


def form_similarity(a: tuple[str, str], b: tuple[str, str], common: frozenset[str] = frozenset()) -> float:
    """Similarity of (given, middle) pairs with full given names; two ``common`` names are no slips of each other."""
    s = given_similarity(a[0], b[0])
    if s == 0.9 and a[0] in common and b[0] in common:
        return 0.0
    if s and a[1] and b[1]:
        return s if a[1][0] == b[1][0] else 0.3 * s
    return s if a[1] == b[1] else 0.95 * s


def average_linkage(sim: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Group number of each row: the closest two groups merge while their mean similarity reaches the threshold; ties go to the heavier pair."""
    n = len(sim)
    label = np.arange(n)
    if n < 2:
        return label
    s = sim.astype(float).copy()
    np.fill_diagonal(s, -1)
    size = np.ones(n)
    w = np.ones(n) if weight is None else weight.astype(float)
    tie = 1e-6 * np.log1p(w)
    while True:
        score = s + tie[:, None] + tie[None, :]
        i, j = divmod(int(np.argmax(score)), n)
        if s[i, j] < threshold:
            return label
        i, j = min(i, j), max(i, j)
        s[i] = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        s[:, i] = s[i]
        s[i, i] = -1
        s[j] = s[:, j] = -1
        size[i] += size[j]
        w[i] += w[j]
        tie[i] = 1e-6 * np.log1p(w[i])
        label[label == j] = i


def grams(s: str) -> list[str]:
    p = f"##{s}$$"
    return sorted({p[i : i + 3] for i in range(len(p) - 2)})


def similar_strings(left: DataFrame, right: DataFrame, threshold: float = COSINE, top: int = TOP) -> DataFrame:
    """(a, b, sim): for each distinct string a of ``left`` its ``top`` strings b of ``right`` with trigram TF-IDF cosine >= threshold.

    Both sides: (s string), distinct and not NULL. Document frequencies are
    taken over both sides.
    """
    spark = left.sparkSession
    both = materialize(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), "strings")
    padded = F.concat(F.lit("##"), "s", F.lit("$$"))
    tri = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
    rows = both.select("s", "side", F.explode(tri).alias("g"))
    df = rows.groupBy("g").agg(F.count("*").alias("n"))
    # few distinct trigrams exist beside many strings: the weights join by shuffle or broadcast as their size allows
    total = both.count()
    weighted = rows.join(df, "g").withColumn("w", F.sqrt(F.log(F.lit(1.0) + total / F.col("n"))))
    vec = weighted.groupBy("s", "side").agg(F.sort_array(F.collect_list(F.struct("n", "g", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    vec = materialize(vec.withColumn("norm", norm).withColumn("v", F.transform("v", lambda x: F.struct(x["n"].alias("n"), x["g"].alias("g"), (x["w"] / F.col("norm")).cast("float").alias("w")))).drop("norm"), "grams")
    # grams up to the point after which less than the threshold is left of the norm
    upto = F.aggregate(
        "v",
        F.struct(F.lit(1.0).alias("rest"), F.lit(0).alias("k")),
        lambda a, x: F.when(a["rest"] < threshold * threshold - 1e-6, a).otherwise(F.struct((a["rest"] - x["w"] * x["w"]).cast("double").alias("rest"), (a["k"] + 1).alias("k"))),
    )["k"]
    post = vec.select("s", "side", "v", F.explode(F.slice("v", F.lit(1), upto)).alias("p")).select(F.col("p.g").alias("g"), "side", "s", F.transform("v", lambda x: x["g"]).alias("gs"), F.transform("v", lambda x: x["w"]).alias("ws"))

    # the left strings of a frequent gram are split, and each part meets copies of the right ones
    size = small(materialize(post.where("side = 0").groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > POSTINGS), "hot-grams"))
    parts = (1 + F.coalesce("_n", F.lit(0)) / POSTINGS).cast("int")
    part = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("s"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    post = post.join(size, "g", "left").withColumn("part", F.explode(part)).select("g", "part", "side", "s", "gs", "ws")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, a, b = None, [], []

        def pairs() -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            if a and b:
                inverted: dict[str, list[tuple[int, float]]] = {}
                for k, (_, gs, ws, _) in enumerate(b):
                    for g, w in zip(gs, ws):
                        inverted.setdefault(g, []).append((k, w))
                for s, gs, ws, _ in a:
                    dot: dict[int, float] = {}
                    first: dict[int, str] = {}
                    for g, w in zip(gs, ws):
                        for k, x in inverted.get(g, ()):
                            if k not in dot:
                                first[k] = g
                            dot[k] = dot.get(k, 0.0) + w * x
                    # a pair comes out where its first common gram is; no more than the best of them can count in the end
                    hits = [(d, b[k][0]) for k, d in dot.items() if d >= threshold and first[k] == gram[0]]
                    for d, x in sorted(hits, reverse=True)[:top] if len(hits) > top else hits:
                        out[0].append(s)
                        out[1].append(x)
                        out[2].append(d)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["a", "b", "sim"])

        for batch in batches:
            for g, part, side, s, gs, ws in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (g, part) != gram:
                    if a and b:
                        yield pairs()
                    gram, a, b = (g, part), [], []
                (b if side else a).append((s, gs, ws, None))
        if a and b:
            yield pairs()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = post.repartition(tasks, "g", "part").sortWithinPartitions("g", "part", "side").mapInArrow(run, "a string, b string, sim double")
    ranked = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), False), 1, top).alias("t"))
    return ranked.select("a", F.explode("t").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.sim").alias("sim"))


def _read(names: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in names:
        rows = [(n, s, g, m, c) for n, c in zip(pdf["name"], pdf["n"]) for s, g, m in readings(n) if s and g]
        yield pd.DataFrame(rows, columns=["name", "surname", "given", "middle", "n"])


def _read_persons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for sid, first, last, full in zip(pdf["sid"], pdf["first"], pdf["last"], pdf["full"]):
            found = set()
            if full and full.strip():
                r = readings(full)
                found |= set(r[:1])
                if last and len(r) > 1 and edits("".join(fold(last).split()), r[1][0]) <= 2 < edits("".join(fold(last).split()), r[0][0]):
                    found = {r[1]}
            if last and last.strip() and first and first.strip():
                r = readings(f"{last.split(',')[0]}, {first}")
                middle = next((x[2] for x in found), "")
                found |= {(s, g, m or middle) for s, g, m in r}
            elif last and last.strip():
                s = readings(f"{last.split(',')[0]}, x")
                found |= {(s[0][0], g, m) for _, g, m in list(found)} if s else set()
            found |= {(s.split("-")[0], g, m) for s, g, m in found if "-" in s}  # double surnames lose their second half
            rows += [(sid, s, g, m) for s, g, m in found if s and g]
        yield pd.DataFrame(rows, columns=["sid", "surname", "given", "middle"])


@lru_cache(50_000)
def deletions(x: str) -> frozenset[str]:
    """``x`` without any none, one or two of its letters: strings within two edits share one."""
    out = {x}
    for _ in range(2):
        out |= {y[:i] + y[i + 1 :] for y in out for i in range(len(y))}
    return frozenset(out)


def components_of_givens(givens: list[str]) -> list[list[int]]:
    """Rows whose given names are linked by similarity above 0, directly or over others; no pair without a key in common is compared."""
    rows: dict[str, list[int]] = {}
    for k, g in enumerate(givens):
        rows.setdefault(g, []).append(k)
    names = sorted(rows)
    up = {g: g for g in names}

    def root(g: str) -> str:
        while up[g] != g:
            up[g] = g = up[up[g]]
        return g

    held: dict[str, list[str]] = {}
    for g in names:
        seen = set()
        for x in SEVERAL.get(g, (SHORT.get(g, g),)):
            for key in deletions(x):
                for other in held.get(key, ()):
                    if other not in seen:
                        seen.add(other)
                        if root(g) != root(other) and given_similarity(g, other):
                            up[root(g)] = root(other)
                held.setdefault(key, []).append(g)
    out: dict[str, list[int]] = {}
    for g in names:
        out.setdefault(root(g), []).extend(rows[g])
    return [sorted(x) for x in out.values()]


def link_block(persons: list[tuple[str, str, str]], forms: list[tuple[str, str, str, int]], common: frozenset[str] = frozenset()) -> list[tuple[str, str, str, str, int]]:
    """Links within one surname: (surname, given, middle, sid, sure) from persons (sid, given, middle) and forms (surname, given, middle, n)."""
    out = []
    full = sorted({(g, m) for _, g, m in persons if len(g) > 1} | {(g, m) for _, g, m, _ in forms if len(g) > 1})
    count = Counter()
    for _, g, m, n in forms:
        count[g, m] += n
    for _, g, m in persons:
        count[g, m] += 1
    at = {f: k for k, f in enumerate(full)}
    label = np.arange(len(full))
    # groups only grow between forms of similar given names: each such component is clustered on its own
    for part in components_of_givens([g for g, _ in full]):
        if len(part) > 1:
            sim = np.zeros((len(part), len(part)))
            for i, a in enumerate(part):
                for j, b in enumerate(part[:i]):
                    sim[i, j] = sim[j, i] = form_similarity(full[a], full[b], common)
            idx = np.array(part)
            label[idx] = idx[average_linkage(sim, LINKAGE, np.array([count[full[k]] for k in part]))]
    group: dict[tuple[str, str], tuple] = {f: (int(label[k]),) for f, k in at.items()}
    letters: dict[tuple, set[str]] = {}
    middles: dict[tuple, set[str]] = {}
    second: dict[tuple, set[str]] = {}  # initials of the second halves of double given names
    weight: Counter = Counter()
    for (g, m), k in group.items():
        letters.setdefault(k, set()).update(x[0] for x in (g, *SEVERAL.get(g, (SHORT.get(g, g),))))
        middles.setdefault(k, set()).update(m[:1])
        if "-" in g:
            second.setdefault(k, set()).add(g.split("-")[1][:1])
        weight[k] += count[g, m]
    compatible: dict[tuple[str, str], list[tuple]] = {}
    # initials: to the heaviest compatible group; alike middle initials go first
    for g, m in sorted({(g, m) for _, g, m in persons if len(g) == 1} | {(g, m) for _, g, m, _ in forms if len(g) == 1}):
        rest = {k: m[1:] if m and m[0] in second.get(k, ()) else m for k in letters}
        fits = [k for k in letters if g in letters[k] and (not rest[k] or not middles[k] or rest[k][0] in middles[k])]
        alike = [k for k in fits if m and (rest[k] != m or m[0] in middles[k])]
        fits = alike or fits
        if fits:
            best = max(fits, key=lambda k: (weight[k], k))
            compatible[g, m] = fits
            group[g, m] = best if weight[best] >= SHARE * sum(weight[k] for k in fits) else ("?", g, m)
        else:
            group[g, m] = (g, m[:1])
    members: dict[tuple, set[str]] = {}
    for sid, g, m in persons:
        members.setdefault(group[g, m], set()).add(sid)
    # initials of persons and authors with and without a middle initial meet
    for s, g, m, _ in forms:
        k = group[g, m]
        sure = set(members.get(k, ()))
        if len(g) == 1 and isinstance(k[0], str) and k[0] != "?":
            for k2, sids in members.items():
                if isinstance(k2[0], str) and k2[0] == g and (not m or len(k2) < 2 or not k2[1] or k2[1] == m[0]):
                    sure |= sids
        maybe = set().union(*(members.get(x, set()) for x in compatible.get((g, m), ()))) - sure
        if len(g) > 1:
            for k2, sids in members.items():
                if isinstance(k2[0], str) and k2[0] in letters[k] and (not m or len(k2) < 2 or not k2[1] or k2[1] == m[0]):
                    maybe |= sids - sure
            # the same given name with another or no middle initial
            maybe |= {sid for sid, g2, m2 in persons if len(g2) > 1 and given_similarity(g, g2) and not (m and m2 and m[0] != m2[0])} - sure
        out += [(s, g, m, sid, 1) for sid in sorted(sure)] + [(s, g, m, sid, 0) for sid in sorted(maybe)]
    return out


def link_names(values: DataFrame, name: str, keys: list[str], persons: DataFrame, listed: DataFrame | None = None, work: str | None = None) -> DataFrame:
    """(*keys, sid): each name value with every person it refers to.

    ``values``: keys and a name; ``persons``: (sid, first, last, full), any of
    the names may be NULL; ``listed``: (sid, ``work``) of works that persons
    claim, ``work`` being one of the keys. A value whose name fits several
    persons goes to those who list its work, else to the likeliest group.
    NULL, empty and single-word names and institutions give no row. Repeated
    rows of any table change nothing.
    """
    names = materialize(values.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")), "names")
    read = materialize(names.mapInPandas(_read, "name string, surname string, given string, middle string, n long"), "readings")
    people = materialize(persons.select("sid", "first", "last", "full").where("sid is not null").distinct().mapInPandas(_read_persons, "sid string, surname string, given string, middle string").distinct(), "people")
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = read.where("length(given) > 1").groupBy("given").agg(F.sum("n").alias("c")).where(F.col("c") * COMMON >= 2 * total)
    common = frozenset(r["given"] for r in often.collect())  # at most COMMON names, as a value has two readings
    near = similar_strings(read.select(F.col("surname").alias("s")).distinct(), people.select(F.col("surname").alias("s")).distinct())

    def slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [edits(a, b) for a, b in zip(pdf["a"], pdf["b"])]
            ok = [x == 0 or x == 1 or (x == 2 and len(a) >= 8) for x, a in zip(d, pdf["a"])]
            yield pdf.assign(d=d)[ok][["a", "b", "d"]]

    near = near.mapInPandas(slips, "a string, b string, d int")
    # a surname that is a person's own is not read as a slip of another one
    best = near.groupBy("a").agg(F.min("d").alias("least"), F.collect_list(F.struct("b", "d")).alias("t"))
    near = materialize(best.select("a", "least", F.explode("t").alias("x")).where("x.d = least").select(F.col("a").alias("surname"), F.col("x.b").alias("block")), "surnames")
    # the tables below grow with the input and shrink many times when written: Spark would broadcast them by the size of their files
    forms = read.groupBy("surname", "given", "middle").agg(F.sum("n").alias("n")).join(near.hint("merge"), "surname")
    block = forms.select("block", F.lit(1).alias("kind"), F.col("surname").alias("key"), "given", "middle", "n").unionByName(people.select(F.col("surname").alias("block"), F.lit(0).alias("kind"), F.col("sid").alias("key"), "given", "middle", F.lit(0).cast("long").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, people_, forms_ = None, [], []

        def close() -> pa.RecordBatch:
            rows = link_block(people_, forms_, common) if people_ and forms_ else []
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["surname", "given", "middle", "sid", "sure"])

        for batch in batches:
            for b, kind, key, g, m, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if b != at:
                    if at is not None:
                        yield close()
                    at, people_, forms_ = b, [], []
                if kind:
                    forms_.append((key, g, m, n))
                else:
                    people_.append((key, g, m))
        if at is not None:
            yield close()

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = block.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(run, "surname string, given string, middle string, sid string, sure int")
    links = links.groupBy("surname", "given", "middle", "sid").agg(F.max("sure").alias("sure"))
    by_name = read.select("name", "n", "surname", "given", "middle").hint("merge").join(links, ["surname", "given", "middle"]).groupBy("name", "sid").agg(F.max("sure").alias("sure"), F.max("n").alias("n"))
    by_name = materialize(by_name.groupBy("name").agg(F.max("n").alias("_n"), F.collect_list(F.struct("sid", "sure")).alias("t")), "name-links")
    wide = salted_lookup(values.select(*keys, F.col(name).alias("name")), by_name, ["name"], merge=True).drop("name").select(*keys, F.explode("t").alias("x")).select(*keys, F.col("x.sid").alias("sid"), F.col("x.sure").alias("sure"))
    if listed is None:
        return wide.where("sure = 1").select(*keys, "sid").distinct()
    claim = listed.select("sid", F.col(work)).where(f"sid is not null and {work} is not null").distinct().withColumn("claimed", F.lit(1))
    wide = materialize(wide.join(claim.hint("merge"), ["sid", work], "left").withColumn("claimed", F.coalesce("claimed", F.lit(0))), "values")
    decided = wide.where("claimed = 1").groupBy(*keys).agg(F.max("sure").alias("own"))
    kept = wide.join(decided.hint("merge"), keys, "left").where("(own is null and sure = 1) or (own = 1 and sure = 1) or (own = 0 and claimed = 1)")
    return kept.select(*keys, "sid").distinct()
