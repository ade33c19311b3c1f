"""The paths for groups too big for one task and tables of many buckets, reached by lowering
what a group or a bucket may hold."""

from __future__ import annotations

from . import grouping, joining, loading, windowing
from .common import Query
from .joining import joined, on, pick

QUERIES: dict[str, Query] = {}

_SETTING = "spark.plumbline.groupRows"
# Rows of a group left to one task: some customers have more orders, most have fewer.
_PER_CUSTOMER, _PER_TABLE = 18, 3_000


def with_setting(name: str, value: str, query: Query) -> Query:
    """The same query and SQL; the plan is chosen while the query is being defined."""

    def run(spark, folder):
        before = spark.conf.get(name, None)
        spark.conf.set(name, value)
        try:
            return query.run(spark, folder)
        finally:
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)

    return Query(run, query.sql)


def with_groups_of(rows: int, query: Query) -> Query:
    return with_setting(_SETTING, str(rows), query)


_LEFT = Query(
    joined(
        {"c": "customer", "o": "orders"},
        [on(("c_custkey", "o_custkey"))],
        pick("c", "c_custkey") + pick("o", "o_orderkey"),
    ),
    "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
)
QUERIES["join_left_hot"] = with_groups_of(_PER_CUSTOMER, _LEFT)
for _kind in ("right", "full"):
    QUERIES[f"join_{_kind}_hot"] = with_groups_of(_PER_CUSTOMER, joining.QUERIES[f"join_{_kind}"])
for _fn in windowing.FUNCTIONS:
    QUERIES[f"window_{_fn}_hot"] = with_groups_of(_PER_CUSTOMER, windowing.QUERIES[f"window_{_fn}"])
for _fn in windowing.WITHOUT_KEYS:
    _name = f"window_global_{_fn}"
    QUERIES[f"{_name}_hot"] = with_groups_of(_PER_TABLE, windowing.QUERIES[_name])
for _name in ("group_median", "group_median_few_groups", "group_global"):
    QUERIES[f"{_name}_hot"] = with_groups_of(_PER_TABLE, grouping.QUERIES[_name])

# Some tens of kilobytes of orders: a few dozen buckets, split further as the table grows.
for _name in (
    "inc_delete_insert",
    "inc_merge_latest_per_key",
    "inc_merge_keeps_missing_columns",
    "inc_group_append_only",
    "stream_delete_insert",
):
    QUERIES[f"{_name}_buckets"] = with_setting(
        "spark.plumbline.bucketBytes", "50000", loading.QUERIES[_name]
    )
