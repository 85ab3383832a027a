"""Guarded ad-hoc SQL: one SELECT over listed tables, listed functions, at most ROWS rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

ROWS = 5_000
# Functions ad-hoc queries may call.
FUNCTIONS = frozenset(
    """abs array_contains array_distinct array_join array_sort avg bool_and bool_or cast ceil coalesce collect_list collect_set concat concat_ws contains
    corr count count_if date_trunc datediff dense_rank element_at endswith exists explode exp extract filter first flatten floor from_json greatest hash
    if ifnull initcap instr isnull isnotnull lag last lead least left length like ln log log10 log1p lower lpad ltrim map_keys map_values max max_by md5
    median min min_by mod month named_struct ntile nullif nvl percent_rank percentile percentile_approx posexplode pow power quarter rank regexp_extract
    regexp_extract_all regexp_like regexp_replace replace reverse right round row_number rpad rtrim sha2 sign size slice sort_array split sqrt startswith
    stddev stddev_pop stddev_samp struct substr substring sum to_date to_json transform trim try_cast try_divide upper var_pop var_samp variance when year
    approx_count_distinct any_value array aggregate grouping grouping_id and or not in between isnan xxhash64 mode string int bigint double date""".split()
)


class Rejected(ValueError):
    """The query is not allowed."""


# Kinds of plan nodes of which a query may consist.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Except Intersect Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith
    UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable OneRowRelation LocalRelation Pivot Unpivot Generate WithWindowDefinition Window UnresolvedHint""".split()
)


def _walk(spark: SparkSession, plan: JavaObject) -> Iterator[JavaObject]:
    """Every plan node and expression below ``plan``, CTE bodies and subqueries included."""
    sc = spark.sparkContext
    of = lambda x, name: is_instance_of(sc._gateway, x, name)
    todo = [plan]
    while todo:
        x = todo.pop()
        if not isinstance(x, JavaObject):
            continue
        if of(x, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            yield x
        elif not (of(x, "scala.Option") or of(x, "scala.collection.Iterable") or re.fullmatch(r"scala\.Tuple\d+(\$.*)?", x.getClass().getName())):
            continue
        it = x.iterator() if of(x, "scala.collection.Iterable") and not of(x, "scala.Option") else x.productIterator()
        while it.hasNext():
            todo.append(it.next())


def _parts(spark: SparkSession, seq: JavaObject) -> list[str]:
    return [str(p) for p in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq)]


def check(spark: SparkSession, sql: str, tables: set[str]) -> bool:
    """Raise Rejected unless the query is allowed; return whether its outer node limits the rows.

    Tables, functions and kinds of nodes are read off the parsed plan, never
    off the text, so quoting and comments can hide nothing.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected("Only SELECT queries are allowed.") from e
    nodes = [(x.getClass().getSimpleName().rstrip("$"), x) for x in _walk(spark, plan)]
    is_plan = lambda x: is_instance_of(spark.sparkContext._gateway, x, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    ctes: set[str] = set()
    for kind, x in nodes:
        if kind == "UnresolvedWith":
            it = x.cteRelations().iterator()
            while it.hasNext():
                ctes.add(str(it.next().productElement(0)).lower())
    known = {t.lower() for t in tables} | ctes
    for kind, x in nodes:
        if kind == "UnresolvedTableValuedFunction":
            raise Rejected("Blocked function")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = _parts(spark, x.nameParts()) if kind == "UnresolvedFunction" else [str(x.name().unquotedString())]
            if len(name) > 1 or name[0].lower() not in FUNCTIONS:
                raise Rejected(f"Blocked function: {'.'.join(name).lower()}")
        elif kind == "UnresolvedRelation":
            name = _parts(spark, x.multipartIdentifier())
            if len(name) > 1 or name[0].lower() not in known:
                raise Rejected("Table not in allowlist")
        elif "UnresolvedIdentifier" in kind or (is_plan(x) and kind not in NODES):
            raise Rejected("Only SELECT queries are allowed.")
    top = plan.child() if nodes[0][0] == "UnresolvedWith" else plan
    return top.getClass().getSimpleName() == "GlobalLimit"


def guarded_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = ROWS, args: list | None = None) -> DataFrame:
    """Run a checked query in a session that knows only the given tables."""
    limited = check(spark, sql, set(tables))
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        view = f"_{name}_guarded"
        df.createOrReplaceGlobalTempView(view)
        session.table(f"global_temp.{view}").createOrReplaceTempView(name)
    out = session.sql(sql, args=args) if args else session.sql(sql)
    return out if limited else out.limit(rows)
