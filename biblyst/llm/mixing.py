"""Mixing sources to target weights, in tokens of a public tokenizer.

Weights come from temperature mixing: token shares are raised to an exponent
that is bisected until the mix meets its condition. Towards target shares the
exponent tilts the natural shares q to the targets t (q^(1-a) t^a): a = 1 is
the target itself, and the largest a at which no source exceeds its repetition
limit is taken. Without targets, q^a is bisected to an entropy.

A source's budget is realised as whole passes over its documents and one
partial pass: documents stand in a seeded permutation cut into blocks; whole
blocks are taken while they fit, and the block at the edge is cut by a running
sum, so no source is ever sorted or summed in one task.
"""

from __future__ import annotations

import base64
import importlib.util
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblyst.session import materialize

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
BLOCKS = 1024
MAX_SOURCES = 10_000


def count_tokens(df: DataFrame, text: str, out: str = "tokens", folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of the text; NULL and empty texts have 0."""

    # read once, here: the workers need no folder of their own
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    sent = df.sparkSession.sparkContext.broadcast((files.PATTERN, (Path(folder) / name).read_bytes()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        pattern, vocabulary = sent.value
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            # a very long text is counted in pieces cut at line ends or blanks, so memory stays bounded
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(**{out: pd.Series(n, dtype="int64")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.mapInPandas(run, f"{schema}, {out} long")


def pieces(t: str, size: int = 1 << 20) -> Iterator[str]:
    """``t`` in pieces of about ``size`` characters, each but the first beginning with a blank."""
    a = 0
    while len(t) - a > size:
        cut = t.find(" ", a + size)
        if cut < 0:
            break
        yield t[a:cut]
        a = cut
    yield t[a:]


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def temperature_weights(shares: list[float], target_entropy: float) -> tuple[list[float], float]:
    """(weights, exponent): shares ** exponent, normalised, with the entropy asked for (clipped to what is possible)."""

    def mix(a: float) -> list[float]:
        w = [x**a if x > 0 else 0.0 for x in shares]
        s = sum(w)
        return [x / s for x in w] if s else w

    lo, hi = 0.0, 64.0  # entropy falls as the exponent grows
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mix(mid)) > target_entropy else (lo, mid)
    return mix((lo + hi) / 2), (lo + hi) / 2


def tilted_weights(sizes: list[float], targets: list[float], limits: list[float], total: float) -> tuple[list[float], float]:
    """(weights, exponent) closest to the targets at which no source is used more than its limit allows.

    Sources that are empty or have no target get 0. If even the natural shares
    break a limit, the limits are met by capping and sharing out the rest.
    """
    size = sum(sizes)

    def mix(a: float) -> list[float]:
        w = [(n / size) ** (1 - a) * t**a if n > 0 and t > 0 else 0.0 for n, t in zip(sizes, targets)]
        s = sum(w)
        return [x / s for x in w] if s else w

    def fits(w: list[float]) -> bool:
        return all(x * total <= m * n * (1 + 1e-12) + 1e-9 for x, m, n in zip(w, limits, sizes))

    if fits(mix(1.0)):
        return mix(1.0), 1.0
    lo, hi = 0.0, 1.0
    if not fits(mix(0.0)):
        w = mix(0.0)
        for _ in range(len(w)):
            over = [x * total > m * n for x, m, n in zip(w, limits, sizes)]
            if not any(over):
                break
            w = [min(x, m * n / total) for x, m, n in zip(w, limits, sizes)]
            free = sum(x for x, o in zip(w, over) if not o)
            lack = 1 - sum(w)
            w = [x if o or not free else x * (1 + lack / free) for x, o in zip(w, over)]
        return [min(x, m * n / total) for x, m, n in zip(w, limits, sizes)], 0.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mix(mid)) else (lo, mid)
    return mix(lo), lo


def _name(c: str) -> F.Column:
    return F.lower(F.trim(F.col(c)))


def entropy_weights(sizes: list[float], target_entropy: float, limits: list[float], total: float) -> tuple[list[float], float]:
    """(weights, exponent): q ** exponent, normalised, for natural shares q, with the entropy asked for as far as the limits allow.

    An exponent below 1 flattens the mix. If a source would be used more than its
    limit allows, the exponent is bisected towards 1, the natural shares, until
    it isn't; if even those break a limit, the source is capped and the rest shared out.
    """
    size = sum(sizes)
    shares = [x / size if size else 0.0 for x in sizes]
    w, a = temperature_weights(shares, target_entropy)
    fits = lambda w: all(x * total <= m * n * (1 + 1e-12) + 1e-9 for x, m, n in zip(w, limits, sizes))
    if fits(w):
        return w, a
    return tilted_weights(sizes, w, limits, total)[0], _between(shares, a, fits)


def _between(shares: list[float], a: float, fits: Callable[[list[float]], bool]) -> float:
    """The exponent nearest to ``a`` between it and 1 at which the limits hold; 1 if there is none."""

    def mix(x: float) -> list[float]:
        w = [s**x if s > 0 else 0.0 for s in shares]
        return [v / sum(w) for v in w] if sum(w) else w

    lo, hi = 0.0, 1.0  # part of the way from 1 to a
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mix(1 + mid * (a - 1))) else (lo, mid)
    return 1 + lo * (a - 1)


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | float | None = None, target_entropy: float | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(plan, report) of a mix of ``total`` tokens.

    ``targets``: (source, target_share, max_repeats). Sources are compared
    without case and surrounding blanks; documents of no listed source are not
    used and come out in the report's last row (source NULL). Without ``total``
    the largest total is taken at which every source meets its target within
    its limit; a float is a part of the tokens of the listed sources. With
    ``target_entropy`` (nats) the mix follows the natural shares at that entropy
    instead of the targets. plan: (doc_id, source, tokens, repeats), used documents only;
    report: (source, target_share, max_repeats, docs, tokens, budget_tokens,
    used_tokens, actual_share, most_repeats, exponent). A listed source without tokens
    or repeats has an actual share of 0 and its weight goes to the others. Targets are
    normalised to sum 1; NULL or negative ones read as 0.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), _name(source).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sized = materialize(count_tokens(src, "text", folder=folder), "tokens")
    rows = targets.select(_name(source).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(1)).alias("m")).where("source is not null").groupBy("source").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("t"), F.max("m").alias("m"))
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    joined = rows.join(totals, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(joined) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    n = [float(r["n"] or 0) for r in joined]
    m = [float(max(r["m"], 0)) for r in joined]
    t = [r["t"] if k * x > 0 else 0.0 for r, k, x in zip(joined, m, n)]
    t = [x / sum(t) for x in t] if sum(t) else t
    if total is None:
        total = int(min([k * x / s for k, x, s in zip(m, n, t) if s > 0], default=0))
    elif isinstance(total, float):
        total = int(total * sum(n))
    if not sum(t) or not total:
        w, exponent = [0.0] * len(n), 1.0
    elif target_entropy is not None:
        w, exponent = entropy_weights([x if y > 0 else 0.0 for x, y in zip(n, t)], target_entropy, m, total)
    else:
        w, exponent = tilted_weights(n, t, m, total)
    budget = [int(round(x * total)) for x in w]
    goals = spark.createDataFrame(
        [(r["source"], float(r["t"]), int(r["m"]), int(b), int(b // x) if x else 0, int(b - (b // x) * x) if x else 0) for r, b, x in zip(joined, budget, n)],
        "source string, target_share double, max_repeats int, budget_tokens long, passes int, rest long",
    )
    goals = F.broadcast(goals)  # at most MAX_SOURCES rows
    listed = sized.join(goals.select("source", "passes", "rest"), "source")
    at = F.xxhash64("doc_id", F.lit(seed))
    listed = listed.withColumn("at", at).withColumn("block", F.pmod(F.shiftrightunsigned("at", 40), F.lit(BLOCKS)).cast("int"))
    blocks = listed.groupBy("source", "block").agg(F.sum("tokens").alias("b"), F.first("rest").alias("rest"))  # at most MAX_SOURCES * BLOCKS rows
    upto = F.sum("b").over(Window.partitionBy("source").orderBy("block"))
    blocks = blocks.withColumn("upto", upto).withColumn("kind", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("b") < F.col("rest"), 2).otherwise(0))
    chosen = listed.drop("rest").join(F.broadcast(blocks.select("source", "block", "kind", (F.col("rest") - (F.col("upto") - F.col("b"))).alias("left"))) if len(joined) * BLOCKS <= 1_000_000 else blocks.select("source", "block", "kind", (F.col("rest") - (F.col("upto") - F.col("b"))).alias("left")), ["source", "block"])
    edge = chosen.where("kind = 2").withColumn("run", F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("at", "doc_id")))
    # the document at the edge is taken if that brings the source closer to its budget
    edge = edge.withColumn("extra", (F.col("run") - F.col("tokens") / 2 <= F.col("left")).cast("int")).drop("run")
    rest = chosen.where("kind <> 2").withColumn("extra", F.col("kind"))
    plan = rest.unionByName(edge).withColumn("repeats", F.col("passes") + F.col("extra")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    used = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    other = sized.join(goals.select("source"), "source", "left_anti").agg(F.count("*").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    known = goals.drop("passes", "rest").join(totals.withColumnRenamed("n", "tokens"), "source", "left").join(used, "source", "left")
    report = known.unionByName(other, allowMissingColumns=True).fillna(0, ["docs", "tokens", "budget_tokens", "used_tokens", "most_repeats"])
    whole = used.agg(F.sum("used_tokens").alias("_all"))
    report = report.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.col("_all"), F.lit(0.0)))
    return plan, report.select("source", "target_share", "max_repeats", "docs", "tokens", "budget_tokens", "used_tokens", "actual_share", "most_repeats", F.lit(float(exponent)).alias("exponent"))
