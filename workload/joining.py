"""Join recipes."""

from __future__ import annotations

from plumbline import run_recipe

from .common import Query, Tables, formula, through

QUERIES: dict[str, Query] = {}


def on(*pairs: tuple[str, str], kind: str = "left") -> dict:
    return {"type": kind, "on": [{"left": a, "right": b} for a, b in pairs]}


def pick(alias: str, *columns: str, **renamed: str) -> list[dict]:
    plain = [{"from": alias, "column": c} for c in columns]
    return plain + [{"from": alias, "column": c, "as": n} for n, c in renamed.items()]


def joined(inputs: dict[str, str], joins: list[dict], select: list[dict] | None = None, made=None):
    """A join of tables; ``made`` prepares some of the inputs first."""

    def run(spark, folder):
        tables = Tables(spark, folder)
        datasets = {
            alias: through(spark, tables[table], *(made or {}).get(alias, []))
            for alias, table in inputs.items()
        }
        spec = {
            "type": "join",
            "inputs": [{"ref": t, "alias": a} for a, t in inputs.items()],
            "joins": joins,
            "select": select or [],
        }
        return run_recipe(spark, spec, datasets)

    return run


# Orders whose customer may be missing, and customers whose key may be missing too.
_HALF = {
    "o": [formula("o_custkey", "case when o_totalprice > 50000 then o_custkey end")],
    "c": [("filter_formula", {"condition": "c_acctbal > 0"})],
}
_HALF_SQL = """with o as (select o_orderkey,
    case when o_totalprice > 50000 then o_custkey end as o_custkey from orders),
    c as (select * from customer where c_acctbal > 0) """
for _kind in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_kind}"] = Query(
        joined(
            {"o": "orders", "c": "customer"},
            [on(("o_custkey", "c_custkey"), kind=_kind)],
            pick("o", "o_orderkey", "o_custkey") + pick("c", "c_custkey", segment="c_mktsegment"),
            _HALF,
        ),
        _HALF_SQL
        + f"""select o_orderkey, o_custkey, c_custkey, c_mktsegment as segment
        from o {_kind} join c on o.o_custkey = c.c_custkey""",
    )
QUERIES["join_cross"] = Query(
    joined(
        {"c": "customer", "r": "region"},
        [{"type": "cross"}],
        pick("c", "c_custkey") + pick("r", "r_name"),
    ),
    "select c_custkey, r_name from customer cross join region",
)
QUERIES["join_multikey"] = Query(
    joined(
        {"l": "lineitem", "s": "supplier"},
        [on(("l_suppkey", "s_suppkey"), ("nation", "s_nationkey"), kind="inner")],
        pick("l", "l_orderkey", "l_linenumber") + pick("s", "s_name"),
        {"l": [formula("nation", "cast(l_linenumber * 3 as int)")]},
    ),
    """select l_orderkey, l_linenumber, s_name from lineitem join supplier
    on l_suppkey = s_suppkey and l_linenumber * 3 = s_nationkey""",
)
QUERIES["join_star"] = Query(
    joined(
        {"l": "lineitem", "p": "part", "s": "supplier", "o": "orders"},
        [
            on(("l_partkey", "p_partkey"), kind="inner"),
            on(("l_suppkey", "s_suppkey")),
            on(("l_orderkey", "o_orderkey")),
        ],
        pick("l", "l_orderkey", "l_linenumber", "l_quantity")
        + pick("p", "p_brand")
        + pick("s", supplier="s_name")
        + pick("o", "o_orderdate"),
    ),
    """select l_orderkey, l_linenumber, l_quantity, p_brand, s_name as supplier, o_orderdate
    from lineitem l join part p on l.l_partkey = p.p_partkey
    left join supplier s on l.l_suppkey = s.s_suppkey
    left join orders o on l.l_orderkey = o.o_orderkey""",
)
QUERIES["join_self"] = Query(
    joined(
        {"a": "conversations", "b": "conversations"},
        [on(("conv_id", "conv_id"), ("before", "turn"), kind="inner")],
        pick("a", "conv_id", "turn", "role") + pick("b", previous="role"),
        {"a": [formula("before", "turn - 1")]},
    ),
    """select a.conv_id, a.turn, a.role, b.role as previous from conversations a
    join conversations b on a.conv_id = b.conv_id and a.turn - 1 = b.turn""",
)
QUERIES["join_select_all"] = Query(
    joined({"d": "documents", "l": "labels"}, [on(("doc_id", "doc_id"))]),
    """select d.*, l.doc_id as l_doc_id, l.quality, l.toxic
    from documents d left join labels l on d.doc_id = l.doc_id""",
)
