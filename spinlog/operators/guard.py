"""Free read-only SQL over published views, under guard rails.

Spark's own parser decides what a text is; nothing is executed before that.
The query then runs in a session of its own that knows the published views and
nothing else, with a row cap and a time limit.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spinlog.errors import QueryTimeoutError, SqlGuardError

MAX_ROWS, TIMEOUT_S = 5000, 10.0

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_FORBIDDEN_NODES = [
    _LOGICAL + "Command",
    _LOGICAL + "ParsedStatement",
    _LOGICAL + "ScriptTransformation",
    _LOGICAL + "ExecutableDuringAnalysis",
]
_FORBIDDEN_NAMES = ("ExecuteImmediate", "WithUnresolvedIdentifier")

# Groups of Spark's built-in functions that only compute from their arguments, by the names Spark gives
# them; "misc_funcs" mixes these with functions that call Java or tell about the session and its files.
CLOSED_GROUPS = {"misc_funcs", ""}
OPEN_FUNCTIONS = {"typeof", "uuid", "equal_null", "monotonically_increasing_id", "range"}


def allowed_functions(spark: SparkSession) -> set[str]:
    infos = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()
    return {i.getName().lower() for i in infos if (i.getGroup() or "") not in CLOSED_GROUPS} | OPEN_FUNCTIONS


def _items(seq) -> Iterator[Any]:
    return (seq.apply(i) for i in range(seq.size()))


_QUERY_PLAN = "org.apache.spark.sql.catalyst.plans.QueryPlan"
_PLAN_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _nodes(gateway, node) -> Iterator[Any]:
    """A plan or expression with all below it: children, expressions, CTE bodies, subquery plans."""
    yield node
    below = list(_items(node.children()))
    if is_instance_of(gateway, node, _QUERY_PLAN):
        below += _items(node.expressions())
        below += [n for n in _items(node.innerChildren()) if is_instance_of(gateway, n, _QUERY_PLAN)]
    elif is_instance_of(gateway, node, _PLAN_EXPRESSION):
        below.append(node.plan())
    for child in below:
        yield from _nodes(gateway, child)


def validate(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Raises SqlGuardError unless `sql` is one query over `views` and harmless functions."""
    if not sql.strip():
        raise SqlGuardError("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as exc:
        raise SqlGuardError(f"could not parse: {exc.getMessage()}") from exc
    except Exception as exc:
        raise SqlGuardError(f"could not parse: {exc}") from exc

    gateway = spark._sc._gateway
    root = plan.getClass().getSimpleName()
    if root in ("LocalRelation", "UnresolvedInlineTable", "UnresolvedRelation", "OneRowRelation"):
        raise SqlGuardError(f"only SELECT and WITH queries are allowed; got {root}")
    functions = allowed_functions(spark)
    relations: list[list[str]] = []
    aliases: set[str] = set()
    for node in _nodes(gateway, plan):
        name = node.getClass().getSimpleName()
        if any(is_instance_of(gateway, node, f) for f in _FORBIDDEN_NODES) or any(n in name for n in _FORBIDDEN_NAMES):
            raise SqlGuardError(f"{name} is not allowed: one read-only query only")
        if name == "UnresolvedRelation":
            relations.append(list(_items(node.multipartIdentifier())))
        elif name == "UnresolvedWith":
            aliases |= {pair._1() for pair in _items(node.cteRelations())}
        elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = list(_items(node.nameParts() if name == "UnresolvedFunction" else node.name()))
            if len(parts) > 1 or parts[-1].lower() not in functions:
                raise SqlGuardError(f"function {'.'.join(parts)}() is not allowed")
    known = {v.lower() for v in views | aliases}
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in known:
            raise SqlGuardError(f"{'.'.join(parts)} is not a published view; there are {', '.join(sorted(views))}")


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[dict[str, Any]]
    row_count: int
    truncated: bool
    sql_executed: str


NO_TABLES = "spinlog_guard_without_tables"


class GuardedSql:
    """`publish` registers temporary views in the session it is given and returns their names."""

    def __init__(self, spark: SparkSession, publish: Callable[[SparkSession], list[str]]) -> None:
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.conf.set("spark.sql.session.timeZone", "UTC")
        # Constant expressions run in tasks, where the time limit reaches them, not in the driver's optimizer.
        self.session.conf.set("spark.sql.optimizer.excludedRules", ",".join(
            f"org.apache.spark.sql.catalyst.optimizer.{rule}" for rule in ("ConstantFolding", "ConvertToLocalRelation")))
        self.views = set(publish(self.session))
        # Saved tables are shared between sessions.  In a database without any, a plain name can
        # only be a published view or a name the query itself defines, whatever its scope.
        self.session.sql(f"CREATE DATABASE IF NOT EXISTS {NO_TABLES}")
        self.session.catalog.setCurrentDatabase(NO_TABLES)

    def frame(self, sql: str) -> DataFrame:
        """The checked query as a lazy DataFrame, without cap or limit in time."""
        validate(self.session, sql, self.views)
        try:
            return self.session.sql(sql)
        except AnalysisException as exc:
            raise SqlGuardError(f"not a valid query: {exc.getMessage()}") from exc

    def run(self, sql: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> QueryResult:
        capped = self.frame(sql).limit(max_rows + 1)
        tag = f"guarded-{uuid.uuid4().hex}"
        context = self.session.sparkContext
        expired = threading.Event()

        def cancel() -> None:
            expired.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_s, cancel)
        context.addJobTag(tag)
        timer.start()
        try:
            rows = capped.collect()
        except Exception as exc:
            if expired.is_set():
                raise QueryTimeoutError(f"query ran past {timeout_s:g} s and was cancelled") from exc
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if expired.is_set():
            raise QueryTimeoutError(f"query ran past {timeout_s:g} s")
        kept = rows[:max_rows]
        return QueryResult(
            columns=capped.columns,
            rows=[dict(zip(capped.columns, row, strict=True)) for row in kept],
            row_count=len(kept),
            truncated=len(rows) > max_rows,
            sql_executed=f"SELECT * FROM ({sql.strip().rstrip(';')}) LIMIT {max_rows + 1}",
        )


def describe(spark: SparkSession, views: dict[str, DataFrame]) -> DataFrame:
    """Schema and meaning of the published views, one row per column."""
    rows = [
        (view, place, field.name, field.dataType.simpleString(), field.metadata.get("comment", ""))
        for view, df in views.items()
        for place, field in enumerate(df.schema)
    ]
    schema = T.StructType([
        T.StructField("view", T.StringType()), T.StructField("place", T.IntegerType()),
        T.StructField("column", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("meaning", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)
