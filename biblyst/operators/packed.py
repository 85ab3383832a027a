"""Several values packed in one field: split into one row per value with its position.

Plan: every field is cut into tokens by one regular expression (quoted text,
separators, runs of ordinary characters). Masking the ordinary runs gives the
field's *delimiter skeleton*. Splitting rules are resolved once per distinct
skeleton, joined back (broadcast behind a check of their bytes, otherwise a
salted hash join), and applied positionally: a rule is a list of token ranges, one per value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize

#: Bytes of rules that may be broadcast: the driver holds them several times while it builds the table.
BROADCAST_BYTES = 8 << 20

#: Separators that never occur inside a value unless it is quoted.
HARD = ";；|/\\t\\n\\r"
#: Words that join the last value to a list.
JOINERS = "and|&"

_TOKEN = rf'"(?:[^"]|"")*"|[{HARD}]|,|\s+(?i:{JOINERS})\s+|(?:(?!\s+(?i:{JOINERS})\s)[^"{HARD},])+|"'

# Marks in a skeleton: Q quoted, x run next to a hard separator, w word,
# i initial, j generational suffix, & joiner; separators stand for themselves.
_RUN = re.compile(r"[wij]+|x|Q|.", re.S)
_HARD_MARKS = frozenset(";；|/\t\n\r")


def _mask_run(t: Column) -> Column:
    """Shape of a run of ordinary characters: one mark per word."""
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.when(w.rlike(r"^(?i:jr|sr|ii|iii|iv)\.?$"), "j")
            .when(w.rlike(r"^(?:\p{L}\.?|(?:\p{L}\.){2,}|\p{L}\.?-\p{L}\.?)$"), "i")
            .otherwise("w"),
        ),
        "",
    )


def _resolve(skeleton: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Token ranges (first, count), counted from 1, of the values of one skeleton."""
    out: list[tuple[int, int]] = []
    hard = any(t in _HARD_MARKS for t in tokens)
    segments: list[list[int]] = [[]]  # token numbers between separators that always separate
    for n, t in enumerate(tokens, 1):
        if t in _HARD_MARKS or t == "&":
            segments.append([])
        else:
            segments[-1].append(n)
    for seg in segments:
        if hard:
            parts = [seg]
        else:
            parts = _comma_groups(seg, tokens)
        for p in parts:
            while p and tokens[p[0] - 1] in (",", ""):
                p = p[1:]
            while p and tokens[p[-1] - 1] in (",", ""):
                p = p[:-1]
            if p:
                out.append((p[0], p[-1] - p[0] + 1))
    return out


def _comma_groups(seg: list[int], tokens: list[str]) -> list[list[int]]:
    """Groups of a comma list: "Last, First[, Jr.]" stays together, full names stand alone."""
    cells: list[list[int]] = [[]]
    for n in seg:
        if tokens[n - 1] == ",":
            cells.append([])
        else:
            cells[-1].append(n)
    cells = [[n for n in c if tokens[n - 1] != ""] for c in cells]
    cells = [c for c in cells if c]
    shape = ["".join(tokens[n - 1] for n in c) for c in cells]
    groups: list[list[int]] = []
    k = 0
    while k < len(cells):
        s = shape[k]
        first, last = cells[k][0], cells[k][-1]
        k += 1
        # one word before a comma is a surname, so are two if only initials follow
        if k < len(cells) and ((s in ("w", "wj") and re.fullmatch(r"ww?|w?i+|i+w", shape[k])) or (s == "ww" and re.fullmatch("i+", shape[k]))):
            last = cells[k][-1]
            k += 1
        while k < len(cells) and re.fullmatch(r"j+", shape[k]):
            last = cells[k][-1]
            k += 1
        groups.append(list(range(first, last + 1)))
    return groups


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = [_resolve(s, s.split("\x1f")) for s in pdf["skeleton"]]
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "_n": pdf["_n"], "ranges": [[{"first": a, "count": b} for a, b in p] for p in parts]})


_RULE = T.StructType(
    [
        T.StructField("skeleton", T.StringType()),
        T.StructField("_n", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType())]))),
    ]
)


def clean_value(c: Column) -> Column:
    """Drop enclosing quotes (doubled ones inside read as one), outer blanks and separators; squeeze blanks."""
    c = F.regexp_replace(c, r"^[\s,]+|[\s,]+$", "")
    quoted = c.rlike(r'^"(?:[^"]|"")*"$') & (F.length(c) >= 2)
    inner = F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), '""', '"')
    c = F.when(quoted, inner).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s,;|/]+|[\s,;|/]+$", ""), r"\s+", " "))


def split_packed(df: DataFrame, field: str, keys: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value packed in ``field``: the ``keys`` columns, ``pos`` from 1, ``value``.

    NULL, empty and separator-only fields give no row; values that are empty
    after cleaning are not counted. Repeated input rows give repeated output
    rows. Other columns of ``df`` are ignored, so their names cannot clash.
    Texts of any length are processed whole.
    """
    src = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(field).cast("string").alias("_f")).where(F.col("_f").isNotNull() & (F.trim("_f") != ""))
    toks = src.withColumn("_t", F.regexp_extract_all("_f", F.lit(_TOKEN), F.lit(0))).drop("_f")
    hard = F.exists("_t", lambda t: t.rlike(rf"^[{HARD}]$"))
    toks = toks.withColumn("_h", hard)
    mark = F.transform(
        "_t",
        lambda t: F.when(t.rlike(rf"^(?:[{HARD}]|,)$"), t)
        .when(t.rlike(r'^".*"$') & (F.length(t) > 1), "Q")
        .when(t.rlike(rf"^\s+(?i:{JOINERS})\s+$"), "&")
        .when(F.trim(t) == "", "")
        .when(F.col("_h"), "x")
        .otherwise(_mask_run(t)),
    )
    toks = toks.withColumn("skeleton", F.array_join(mark, "\x1f")).drop("_h")
    rules = materialize(toks.groupBy("skeleton").agg(F.count("*").alias("_n")).mapInPandas(_rules, _RULE), "skeletons")
    # an unsafe row: the string, 32 bytes a range, and what every row has
    size, total = rules.agg(F.coalesce(F.sum(F.octet_length("skeleton") + 32 * F.size("ranges") + 64), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    ruled = toks.join(F.broadcast(rules.drop("_n")), "skeleton") if size <= BROADCAST_BYTES else salted_lookup(toks, rules, ["skeleton"], total=total)
    values = F.transform("ranges", lambda r: clean_value(F.array_join(F.slice("_t", r["first"], r["count"]), "")))
    out = ruled.withColumn("_v", F.filter(values, lambda v: v != ""))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.posexplode("_v").alias("_p", value)).select(*keys, (F.col("_p") + 1).cast("int").alias(pos), value)
