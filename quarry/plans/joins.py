"""Queries for joins and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import catalog, entities, evaluation, retention, statements
from quarry.operators.ranking import top_n
from quarry.plans.registry import query
from quarry.plans.tables import CASHFLOW, STATEMENT, day_text

MENTIONS = """
calls AS (
  SELECT p_brand AS call_id, 'p' || CAST(min(p_partkey) AS VARCHAR) AS m1, upper(split_part(max(p_name), ' ', 2)) AS m2,
         'The ' || min(p_name) || ' Group' AS m3, 'zz top' AS m4 FROM part GROUP BY 1),
mentions AS (SELECT call_id, unnest([m1, m2, m3, m4]) AS mention FROM calls),
master AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS organ_name, p_type AS sector FROM part),
matches AS (
  SELECT call_id, mention, symbol, organ_name, upper(symbol) = upper(mention) AS exact
  FROM mentions JOIN master ON upper(symbol) = upper(mention) OR contains(lower(organ_name), lower(mention)))
"""


def _mentions(data):
    """Four mentions per brand, taken from the whole part table."""
    name = F.col("p_name")
    calls = data.table("part").groupBy(F.col("p_brand").alias("call_id")).agg(
        F.array(
            F.concat(F.lit("p"), F.min("p_partkey").cast("string")),
            F.upper(F.element_at(F.split(F.max(name), " "), 2)),
            F.concat(F.lit("The "), F.min(name), F.lit(" Group")),
            F.lit("zz top"),
        ).alias("mentions")
    )
    return entities.usable_mentions(calls)


def _master(data):
    return data.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("organ_name"),
        F.col("p_type").alias("sector"),
    )


@query(
    "resolve_entities",
    f"""
    WITH {MENTIONS},
    best AS (SELECT call_id, symbol, organ_name, bool_or(exact) AS exact FROM matches GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY exact DESC, symbol) AS rn FROM best)
    SELECT call_id, symbol, r.organ_name, exact, sector FROM ranked r JOIN master USING (symbol)
    """,
)
def _resolve_entities(data):
    master = _master(data)
    found = entities.resolve_entities(_mentions(data), master, master.select("symbol", "sector"))
    return found.select("call_id", "symbol", "organ_name", "exact", "sector")


@query(
    "unresolved_entities",
    f"""
    WITH {MENTIONS}
    SELECT call_id, mention FROM mentions m
    WHERE NOT EXISTS (SELECT 1 FROM matches x WHERE x.call_id = m.call_id AND x.mention = m.mention)
      AND NOT EXISTS (SELECT 1 FROM matches x WHERE x.call_id = m.call_id AND x.organ_name <> ''
                      AND contains(lower(m.mention), lower(x.organ_name)))
    """,
)
def _unresolved_entities(data):
    return entities.unresolved_entities(_mentions(data), _master(data))


@query(
    "join_master_profile",
    """
    SELECT c_custkey, c_name, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def _join_master_profile(data):
    nations = data.table("nation").filter("n_regionkey <> 2")
    profile = nations.join(data.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = data.table("customer").join(profile, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    blank = F.lit("")
    return joined.select(
        "c_custkey", "c_name", F.coalesce("n_name", blank).alias("nation"), F.coalesce("r_name", blank).alias("region")
    )


@query(
    "sector_top",
    """
    SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, round(sum(o_totalprice), 2) AS cap FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    GROUP BY 1 ORDER BY cap DESC, symbol LIMIT 10
    """,
)
def _sector_top(data):
    symbol = F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol")
    members = data.table("customer").filter("c_mktsegment = 'BUILDING'").select(symbol)
    ratios = data.table("orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("cap")
    )
    return statements.sector_ranking(ratios, members, "cap", 10)


@query(
    "stale_groups",
    """
    WITH s AS (SELECT o_custkey AS project_id, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c_custkey AS project_id, strftime(newest, '%Y-%m-%d') AS newest
    FROM customer LEFT JOIN s ON project_id = c_custkey WHERE newest IS NULL OR newest < TIMESTAMP '2000-01-01'
    """,
)
def _stale_groups(data):
    groups = data.table("customer").select(F.col("c_custkey").alias("project_id"))
    sessions = data.table("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("update_at")
    )
    stale = retention.stale_groups(groups, sessions, F.lit("2000-01-01").cast("timestamp_ntz"))
    return stale.select("project_id", day_text("newest").alias("newest"))


@query(
    "sessions_by_owner",
    """
    SELECT CAST(c_nationkey AS BIGINT) AS user_id, o_orderkey AS session_id, o_custkey AS project_id,
           strftime(o_orderdate, '%Y-%m-%d') AS update_at
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def _sessions_by_owner(data):
    projects = data.table("customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("long").alias("user_id")
    )
    sessions = data.table("orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("update_at")
    )
    return catalog.sessions_by_owner(sessions, projects).select("user_id", "session_id", "project_id", day_text("update_at").alias("update_at"))


@query(
    "score_join",
    """
    SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l USING (doc_id)
    """,
)
def _score_join(data):
    captured = data.table("documents").select("doc_id", "lang")
    return evaluation.with_cases(captured, data.table("labels"), "doc_id").select("doc_id", "lang", F.col("quality").cast("long").alias("quality"))


@query(
    "entity_overview",
    f"""
    WITH {STATEMENT}, {CASHFLOW},
    s AS (SELECT symbol, arg_max(revenue, year) AS revenue, max(year) AS year FROM stmt WHERE quarter = 0 GROUP BY 1),
    c AS (SELECT symbol, arg_max(operating, year) AS operating FROM cashflow GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
    h AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol,
                 string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS holders FROM o WHERE rn <= 3 GROUP BY 1)
    SELECT symbol, CAST(year AS DOUBLE) AS year, round(revenue, 2) AS revenue, round(operating, 2) AS operating, holders
    FROM s FULL JOIN c USING (symbol) FULL JOIN h USING (symbol)
    """,
)
def _entity_overview(data):
    statement = top_n(statements.annual(data.statement()), ["symbol"], [F.col("year").desc()], 1)
    cash = top_n(data.cashflow(), ["symbol"], [F.col("year").desc()], 1)
    orders = data.table("orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("o_orderkey").alias("holder"),
        F.col("o_totalprice").alias("amount"),
    )
    holders = statements.top_children(orders, "symbol", "amount", ["holder"], 3)
    joined = statements.overview(statement.select("symbol", "year", "revenue"), cash.select("symbol", "operating"), holders)
    names = F.array_join(F.transform("holders", lambda h: h["holder"].cast("string")), ",")
    return joined.select(
        "symbol",
        F.col("year").cast("double").alias("year"),
        F.round("revenue", 2).alias("revenue"),
        F.round("operating", 2).alias("operating"),
        names.alias("holders"),
    )
