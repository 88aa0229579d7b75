"""DuckDB SQL text for the fixture views and helpers to build oracle queries.

These strings are the *independent* check of each registered Spark query: the same
semantics written as plain SQL over the shared parquet tables (pre-registered views).
"""

from __future__ import annotations

from typing import Iterable

DAY = "date_diff('day', date '2024-01-01', cast(ts as date))"

O_SQL = """
select o_orderkey as patient_id,
  case o_orderstatus when 'F' then 'No' when 'O' then 'Yes' end as M6_Rem,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 5 < 2 then 'No' else 'Yes' end as Y1_Rem,
  case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then null
       when o_orderkey % 5 < 2 or o_orderkey % 3 = 0 then 'No' else 'Yes' end as Y1_Rem_6
from orders
"""

T_SQL = """
select o.o_orderkey as row_id,
  case when o.o_orderkey % 13 = 0 then null else o.o_totalprice end as price,
  case when o.o_orderkey % 17 = 0 then null else c.c_acctbal end as acctbal,
  cast(a.qty as double) as qty, cast(a.n_lines as double) as n_lines, round(a.disc, 6) as disc,
  case when o.o_orderkey % 19 = 0 then null else o.o_orderstatus end as status,
  o.o_orderpriority as priority, c.c_mktsegment as segment, o.o_orderkey % 8 as label
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, sum(l_quantity) as qty, count(*) as n_lines, avg(l_discount) as disc
           from lineitem group by l_orderkey) a on a.l_orderkey = o.o_orderkey
"""

L_SQL = f"""
select user_id as patient_id, cast({DAY} as bigint) as t,
  avg(case when event_type='click'    then value end) as s_click,
  avg(case when event_type='view'     then value end) as s_view,
  avg(case when event_type='error'    then value end) as s_error,
  avg(case when event_type='signup'   then value end) as s_signup,
  avg(case when event_type='purchase' then value end) as s_purchase
from events group by user_id, {DAY}
"""

P_SQL = """
with s as (select o_orderkey as row_id, o_orderkey % 8 as y_true, o_orderkey % 365 + 1 as t_days, c.cls as cls,
    1 + (o_orderkey * (2*c.cls+3) + o_custkey * (c.cls+1)) % 50
      + case when c.cls = o_orderkey % 8 then 25 else 0 end as s
  from orders cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) as c(cls))
select row_id, y_true, t_days, cast(cls as bigint) as cls,
  cast(s as double) / cast(sum(s) over (partition by row_id) as double) as p from s
"""

B_SQL = """
select l.doc_id as row_id, cast(l.toxic as bigint) as y_true,
       least(1.0::double, cast(d.n_chars as double) / 8000.0::double) as score
from labels l join documents d on l.doc_id = d.doc_id
"""

FIXTURE_CTES = {"O": O_SQL, "T": T_SQL, "L": L_SQL, "P": P_SQL, "B": B_SQL}


def with_fixtures(body: str, *names: str, extra: Iterable[tuple[str, str]] = ()) -> str:
    ctes = [f"{n} as ({FIXTURE_CTES[n]})" for n in names]
    ctes += [f"{n} as ({s})" for n, s in extra]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def rounded(sql: str, double_cols: Iterable[str]) -> str:
    """Round listed double columns to 6 places (and normalise -0.0) around a query."""
    cols = list(dict.fromkeys(double_cols))
    if not cols:
        return sql
    rep = ", ".join(f'round(round(cast("{c}" as double), 9), 6) + 0.0 as "{c}"' for c in cols)
    return f"select * replace ({rep}) from ({sql}) _oracle"
