"""Whether an analyst's statement only reads one view.

Spark parses the statement; the tree of the parse decides, node by node and
expression by expression. Texts of plans are never read: they are cut short and
hold the user's own literals.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class SQLRejected(ValueError):
    """The statement is not one reading statement over the view."""


# Classes of Spark's parsed plans that only read what stands below them.
READING = frozenset("""
    Project Filter Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Tail Distinct Join Union
    Intersect Except SubqueryAlias OneRowRelation UnresolvedInlineTable ResolvedInlineTable
    LocalRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases Window
    WithWindowDefinition UnresolvedHaving UnresolvedWith Generate Pivot Unpivot LateralJoin
    Sample RepartitionByExpression Repartition UnresolvedHint UnresolvedOrderByAll
    UnresolvedGroupByAll
    """.split())
# Names left open by the parser that may stand for columns of the statement itself.
OPEN_NAMES = frozenset("""
    UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias
    UnresolvedExtractValue UnresolvedOrdinal UnresolvedRegex UnresolvedNamedLambdaVariable
    UnresolvedWindowExpression UnresolvedStarWithColumns UnresolvedOrderByAll
    """.split())
# Functions that make rows out of their arguments alone.
GENERATORS = frozenset("""
    explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple
    """.split())
# Built-in functions that run code, or read files of the driver.
LEAVING = frozenset("""
    java_method reflect try_reflect from_protobuf to_protobuf input_file_name
    input_file_block_start input_file_block_length
    """.split())


def parsed(spark: SparkSession, query: str):
    """Spark's own parse of one statement; several statements do not parse."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as exc:  # noqa: BLE001 - a Java parse error of any kind
        raise SQLRejected(f"not one readable statement: {str(exc).splitlines()[0]}") from exc


def _each(seq) -> Iterator:
    """Members of a Scala collection."""
    members = seq.iterator()
    while members.hasNext():
        yield members.next()


class Guard:
    """One walk over a parsed plan; ``view`` is the only table."""

    def __init__(self, spark: SparkSession, view: str) -> None:
        self._view = view
        catalyst = spark._jvm.org.apache.spark.sql.catalyst
        self._subquery = spark._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.catalyst.expressions.SubqueryExpression", True,
            spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        self._builtin = {f.funcName().lower() for f in _each(
            catalyst.analysis.FunctionRegistry.builtin().listFunction())}

    def check(self, plan) -> None:
        self._plan(plan, frozenset())

    def _plan(self, plan, named: frozenset[str]) -> None:
        """``named`` holds the WITH names that are in sight."""
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _each(plan.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in named | {self._view}:
                raise SQLRejected(f"unknown table: {'.'.join(parts)}")
            return
        if kind == "UnresolvedTableValuedFunction":
            self._generator(plan.name())
        elif kind not in READING:
            raise SQLRejected(f"not a reading statement: {kind}")
        if kind == "UnresolvedWith":
            recursive = plan.allowRecursion()
            for relation in _each(plan.cteRelations()):
                name = relation._1().lower()
                # a definition sees the names before it, and itself only where it may recur
                self._plan(relation._2(), named | {name} if recursive else named)
                named = named | {name}
        elif kind == "WithWindowDefinition":    # its expressions lie in pairs
            for definition in _each(plan.windowDefinitions().values()):
                self._expression(definition, named)
        for expression in _each(plan.expressions()):
            self._expression(expression, named)
        for child in _each(plan.children()):
            self._plan(child, named)

    def _expression(self, expression, named: frozenset[str]) -> None:
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self._function(expression.nameParts())
        elif kind == "UnresolvedGenerator":
            self._generator([expression.name().funcName()]
                            if expression.name().database().isEmpty() else None)
        elif self._subquery.isInstance(expression):
            self._plan(expression.plan(), named)
        elif "Unresolved" in kind and kind not in OPEN_NAMES:
            raise SQLRejected(f"a name that is settled only when it runs: {kind}")
        for child in _each(expression.children()):
            self._expression(child, named)

    def _function(self, parts) -> None:
        parts = [p.lower() for p in _each(parts)]
        if len(parts) != 1 or parts[0] not in self._builtin or parts[0] in LEAVING:
            raise SQLRejected(f"not a function for analysts: {'.'.join(parts)}")

    def _generator(self, parts) -> None:
        if parts is not None and not isinstance(parts, list):
            parts = list(_each(parts))
        if parts is None or len(parts) != 1 or parts[0].lower() not in GENERATORS:
            raise SQLRejected(f"not a table function for analysts: {parts}")
