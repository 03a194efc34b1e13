"""Is a statement one read-only query over the published tables? Decided on Spark's own parse of it.

The parsed plan is walked with all its expressions, subqueries and named subqueries. Only known kinds of query nodes,
single-name relations and listed functions pass, so anything Spark can parse but this module doesn't know is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: The published tables, as an analyst would explain them.
CATALOGUE = {
    "fact_sales": ("invoice, invoice_date DATE, stock_code, customer_id, country, quantity, unit_price, amount, line_type, is_reversed", "a row for each product line of an invoice; line_type is 'sale' or 'return'; returns have negative quantity and amount; customer_id is null for guests; an order is a distinct invoice with sale lines"),
    "dim_product": ("stock_code, description, first_sold DATE, last_sold DATE", "a row for each product"),
    "dim_customer": ("customer_id, country, first_order_date DATE, last_order_date DATE", "a row for each known customer"),
    "mart_monthly": ("month DATE, revenue, orders, customers, units, returned_value", "a row for each month (its first day); revenue is gross, returned_value positive"),
    "mart_country": ("country, revenue, orders, customers, returned_value", "a row for each country"),
    "mart_product": ("stock_code, description, revenue, units_sold, orders, units_returned, returned_value, median_price", "a row for each product"),
    "mart_customer_rfm": ("customer_id, recency_days, frequency, monetary, r, f, m, segment", "a row for each customer with an order; frequency counts orders, monetary is net spend; r, f and m are scores of 1 to 5; segment is Champions, Loyal, Promising, New, At risk or Lost"),
    "ml_customer_score": ("customer_id, repeat_probability", "the chance of another order in the next 90 days"),
    "ml_forecast": ("stock_code, week_start DATE, actual_units, forecast_units, baseline_units", "weekly demand forecasts of the test weeks beside what was sold"),
}
TABLES = frozenset(CATALOGUE)

#: Kinds of plan nodes that only read.
NODES = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate GlobalLimit LocalLimit Limit Offset Tail Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith CTERelationRef "
    "UnresolvedHaving WithWindowDefinition Union Intersect Except OneRowRelation UnresolvedInlineTable LocalRelation UnresolvedSubqueryColumnAliases Pivot Unpivot Window Generate".split()
)
#: Functions that compute on their arguments alone. Among what is left out are those that reach the JVM, files or the session.
FUNCTIONS = frozenset(
    "abs acos add_months between any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_size asin atan avg bit_and bit_or bool_and bool_or bround cardinality "
    "cast cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date date date_add date_diff date_format date_part date_sub "
    "date_trunc datediff datepart day dayofmonth dayofweek dayofyear decode degrees dense_rank div element_at endswith every exp explode extract first first_value flatten floor from_unixtime greatest hour if ifnull ilike initcap "
    "instr isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left len length like ln locate log log10 log1p log2 lower lpad ltrim make_date max max_by md5 mean median min min_by minute mod mode month "
    "months_between named_struct next_day not nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position posexplode pow power quarter radians rank regexp_count regexp_extract regexp_like regexp_replace "
    "regr_slope repeat replace reverse right rint rlike round row_number rpad rtrim second sequence sha2 sign signum sin size skewness slice sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string "
    "struct substr substring sum tan to_char to_date to_timestamp translate trim trunc try_add try_divide try_multiply try_subtract ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket year".split()
)
VERBS = ("select", "with", "(", "from", "values")


class UnsafeQuery(ValueError):
    """Not one read-only query over the published tables."""


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, tables: frozenset[str]):
        self.tables = tables

    def plan(self, node, names: frozenset[str]) -> None:
        kind = _kind(node)
        if kind == "UnresolvedTableValuedFunction":
            raise UnsafeQuery("table functions are not allowed")
        if kind not in NODES:
            raise UnsafeQuery(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.tables | names:
                raise UnsafeQuery(f"table '{'.'.join(parts)}' is not available")
        if kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                self.plan(relation._2(), names)  # a named subquery sees those before it
                names = names | {relation._1().lower()}
        for expression in _items(node.expressions()):
            self.expression(expression)
        for child in [*_items(node.subqueries()), *_items(node.children())]:
            self.plan(child, names)

    def expression(self, node) -> None:
        kind = _kind(node)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = list(_items(node.nameParts())) if kind == "UnresolvedFunction" else [node.name().unquotedString()]
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise UnsafeQuery(f"function '{'.'.join(parts)}' is not allowed")
        for child in _items(node.children()):
            self.expression(child)


def guard(spark: SparkSession, sql: str, tables: frozenset[str] = TABLES) -> str:
    """The statement, without a trailing semicolon, if it is safe; else UnsafeQuery."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeQuery("there is no query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise UnsafeQuery(f"not one query: {e.getMessage() or str(e)}") from e
    except Exception as e:
        raise UnsafeQuery(f"not one query: {' '.join(str(e).split())[:300]}") from e
    _Walk(tables).plan(plan, frozenset())
    return text
