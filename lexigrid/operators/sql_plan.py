"""What a parsed statement may consist of: kinds of plan, relations and functions, all by lists of what is allowed."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

#: Kinds of plan that a query is made of; commands, scripts and names made at run time are not among them.
PLANS = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation",
    "Project", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedPivot", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Unpivot", "Pivot", "Window", "WithWindowDefinition",
}
#: Unresolved expressions that only name columns, fields, windows or functions that are looked at themselves.
OPEN_NAMES = {
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal",
    "UnresolvedRegex", "UnresolvedStar", "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression",
}
#: Spark's own groups of functions that work on values alone. misc_funcs has those that call Java, read the session or name files.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
MISC = {"monotonically_increasing_id", "typeof", "equal_null", "nullif", "nvl", "nvl2", "ifnull", "uuid"}
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "range", "stack"}

_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, spark: SparkSession, views: set[str]):
        self.gateway = spark.sparkContext._gateway
        self.state = spark._jsparkSession.sessionState()
        self.views = {v.lower() for v in views}
        self.own = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def function(self, name: str) -> None:
        """Refuses a function that is not one of Spark's own, of the allowed groups, or that the session gave another meaning."""
        key = self.identifier(name.lower())
        built, now = self.own.lookupFunction(key), self.state.functionRegistry().lookupFunction(key)
        same = built.isDefined() and now.isDefined() and built.get().getClassName() == now.get().getClassName()
        if not same or not (built.get().getGroup() in GROUPS or name.lower() in MISC):
            raise ValueError(f"{name} is not allowed")

    def one_name(self, parts: JavaObject, what: str) -> str:
        names = list(_items(parts))
        if len(names) != 1:
            raise ValueError(f"a path or another catalogue's {what} is no {what} here")
        return names[0]

    def plan(self, node: JavaObject, own: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in PLANS:
            raise ValueError(f"a query has no {kind}")
        if kind == "UnresolvedWith":
            inner = own
            for relation in _items(node.cteRelations()):
                # a later name may use an earlier one, and one that calls itself only itself
                self.plan(relation._2(), inner)
                inner |= {relation._1().lower()}
            own = inner
        elif kind == "UnresolvedRelation":
            name = self.one_name(node.multipartIdentifier(), "block")
            if name.lower() not in self.views | own:
                raise ValueError(f"{name} is no declared block")
        elif kind == "UnresolvedTableValuedFunction":
            name = self.one_name(node.name(), "function")
            if name.lower() not in TABLE_FUNCTIONS:
                raise ValueError(f"{name} gives no rows here")
        for child in _items(node.children()):
            self.plan(child, own)
        for expression in _items(node.expressions()):
            self.expression(expression, own)

    def expression(self, node: JavaObject, own: frozenset[str]) -> None:
        kind = _kind(node)
        if kind.startswith("Unresolved") and kind not in OPEN_NAMES or "UnresolvedIdentifier" in kind:
            raise ValueError(f"a query has no {kind}")
        if kind == "UnresolvedFunction":
            self.function(self.one_name(node.nameParts(), "function"))
        elif kind == "UnresolvedGenerator":
            self.function(node.name().funcName())
        if is_instance_of(self.gateway, node, _SUBQUERY):
            self.plan(node.plan(), own)
        for child in _items(node.children()):
            self.expression(child, own)


def check(spark: SparkSession, statement: str, views: set[str]) -> None:
    """Refuses a statement that is more than one query over the views and its own WITH names.

    Spark's parser reads the statement; every plan, relation and function in it,
    in subqueries too, must be one that is allowed, so what is not known is refused.
    """
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise ValueError(f"the statement cannot be read: {str(e)[:300]}") from e
    _Walk(spark, views).plan(parsed, frozenset())
