"""Classification trees: (code, label, level, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.session import materialize


def closure(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose code begins with the text or whose label holds it, with all their ancestors, however deep.

    Parents are followed level by level until no new node comes up; a cycle
    ends there too. A tree is small; each level is one join.
    """
    nodes = materialize(nodes, "tree")
    level = nodes.where(F.upper("code").startswith(text.upper()) | F.lower("label").contains(text.lower())).select("code", "parent")
    seen = materialize(level.select("code").distinct(), "seen")
    while True:
        up = level.where("parent is not null").select(F.col("parent").alias("code")).distinct().join(seen, "code", "left_anti")
        level = materialize(nodes.select("code", "parent").join(up, "code", "left_semi"), "level")
        if not level.limit(1).count():
            return nodes.join(seen, "code", "left_semi")
        seen = materialize(seen.unionByName(level.select("code").distinct()), "seen")


def with_codes(articles: DataFrame, codes: DataFrame, prefixes: list[str], strict: bool = False) -> DataFrame:
    """Articles that carry a code beginning with one of the prefixes; malformed prefixes are dropped, or raise if strict and none is left."""
    import re

    good = [p for p in (x.strip().upper() for x in prefixes) if re.fullmatch(r"[A-Z]\d{0,2}", p)]
    if not good:
        if strict:
            raise ValueError("no valid code")
        return articles
    ok = F.lit(False)
    for p in good:
        ok = ok | F.col("code").startswith(p)
    return articles.join(codes.where(ok).select("handle").distinct(), "handle", "left_semi")
