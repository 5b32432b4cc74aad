"""The flat star-schema and billing benchmarks (P, D1, E, G): selections, grouped sums and averages over one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.flatten import BILLING_SQL, LINEORDER_SQL, billing_flat, lineorder_flat, table, unmatched
from siltstone.queries.base import davg, davg_sql, q



def flat(name: str, where: str, keys: list[str], value: str, as_: str) -> None:
    """SUM of an expression over the flat fact, grouped by keys; empty and without keys it is NULL."""
    by = ", ".join(keys)
    oracle = f"WITH {LINEORDER_SQL} SELECT {by + ', ' if by else ''}CAST(sum({value}) AS DOUBLE) AS {as_} FROM lineorder_flat WHERE {where}" + (f" GROUP BY {by}" if by else "")

    def run(s, d) -> DataFrame:
        df = lineorder_flat(s, d).where(where)
        total = F.sum(F.expr(value)).cast("double").alias(as_)
        return df.groupBy(*keys).agg(total).orderBy(*keys) if keys else df.agg(total)

    q(name, oracle)(run)


PRICE = "CAST(lo_revenue * CAST(lo_discount AS DECIMAL(4,2)) AS DECIMAL(20,4))"
flat("p_flat_q1_1", "d_year = 1996 AND lo_discount BETWEEN 0.01 AND 0.03 AND lo_quantity < 25", [], PRICE, "revenue")
flat("p_flat_q1_2", "d_yearmonth = 199701 AND lo_discount BETWEEN 0.04 AND 0.06 AND lo_quantity BETWEEN 26 AND 35", [], PRICE, "revenue")
flat("p_flat_q1_3", "d_week = 6 AND d_year = 1997 AND lo_discount BETWEEN 0.05 AND 0.07 AND lo_quantity BETWEEN 26 AND 35", [], PRICE, "revenue")
flat("p_flat_q2_1", "p_type = 'PROMO' AND s_region = 'AMERICA'", ["d_year", "p_brand"], "lo_revenue", "revenue")
flat("p_flat_q2_2", "p_brand BETWEEN 'Brand#21' AND 'Brand#25' AND s_region = 'ASIA'", ["d_year", "p_brand"], "lo_revenue", "revenue")
flat("p_flat_q2_3", "p_brand = 'Brand#22' AND s_region = 'EUROPE'", ["d_year", "p_brand"], "lo_revenue", "revenue")
flat("p_flat_q3_1", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1995 AND d_year <= 1997", ["c_nation", "s_nation", "d_year"], "lo_revenue", "revenue")
flat("p_flat_q3_2", "c_nation = 'NATION_3' AND s_nation = 'NATION_3' AND d_year >= 1995 AND d_year <= 1999", ["c_mktsegment", "s_nation", "d_year"], "lo_revenue", "revenue")
flat("p_flat_q3_3", "(c_nation = 'NATION_3' OR c_nation = 'NATION_8') AND (s_nation = 'NATION_3' OR s_nation = 'NATION_8') AND d_year >= 1995 AND d_year <= 1997", ["c_nation", "s_nation", "d_year"], "lo_revenue", "revenue")
flat("p_flat_q3_4", "(c_nation = 'NATION_3' OR c_nation = 'NATION_8') AND (s_nation = 'NATION_3' OR s_nation = 'NATION_8') AND d_yearmonth = 199712", ["c_nation", "s_nation", "d_year"], "lo_revenue", "revenue")
PROFIT = "lo_revenue - lo_supplycost"
flat("p_flat_q4_1", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_type = 'PROMO' OR p_type = 'LARGE')", ["d_year", "c_nation"], PROFIT, "profit")
flat("p_flat_q4_2", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1997 OR d_year = 1998) AND (p_type = 'PROMO' OR p_type = 'LARGE')", ["d_year", "s_nation", "p_type"], PROFIT, "profit")
flat("p_flat_q4_3", "c_region = 'AMERICA' AND s_nation = 'NATION_6' AND (d_year = 1997 OR d_year = 1998) AND p_type = 'SMALL'", ["d_year", "s_nation", "p_brand"], PROFIT, "profit")


def bill(name: str, where: str, keys: list[str], **aggs: str) -> None:
    """aggs: name -> "avg:expression", "min:column" or "max:column" (":int" at the end casts)."""

    def spark(kind: str, x: str):
        if kind == "avg":
            return davg(F.expr(x))
        c = {"min": F.min, "max": F.max}[kind](F.expr(x.removesuffix(":int")))
        return c.cast("bigint") if x.endswith(":int") else c

    def duck(kind: str, x: str) -> str:
        if kind == "avg":
            return davg_sql(x)
        c = f"{kind}({x.removesuffix(':int')})"
        return f"CAST({c} AS BIGINT)" if x.endswith(":int") else c

    by = ", ".join(keys)
    cols = "".join(f", {duck(*x.split(':', 1))} AS {n}" for n, x in aggs.items())
    oracle = f"WITH {BILLING_SQL} SELECT {by}{cols} FROM billing_flat WHERE {where} GROUP BY {by}"

    def run(s, d) -> DataFrame:
        df = billing_flat(s, d).where(where)
        # no aggregate is a DISTINCT; a key named twice in GROUP BY counts once
        return df.groupBy(*dict.fromkeys(keys)).agg(*[spark(*x.split(":", 1)).alias(n) for n, x in aggs.items()]) if aggs else df.select(*keys).distinct()

    q(name, oracle)(run)


DIFF = "avg:allowed - payment"
FOUR = {"avg_diff": DIFF, "avg_allowed": "avg:allowed", "avg_payment": "avg:payment", "avg_charge": "avg:allowed + payment"}
bill("p_bill_q01", "hcpcs = '1-URGENT' AND state = 'NATION_7'", ["city"])
bill("p_bill_q02", "TRUE", ["city"])
bill("p_bill_q03", "city = 'BUILDING' AND state = 'NATION_7'", ["last_name"])
bill("p_bill_q04", "first_name = 'F' AND state = 'NATION_7'", ["last_name", "npi"])
bill("p_bill_q05", "first_name = 'F' AND last_name = 'Customer#000000007'", ["state"])
bill("p_bill_q07", "hcpcs = '5-LOW' AND first_name = 'F' AND state = 'NATION_7'", ["last_name"])
bill("p_bill_q08", "last_name = 'Customer#000000010' AND state <> 'X'", ["first_name", "hcpcs"])
bill("p_bill_q09", "hcpcs = '5-LOW' AND city = 'BUILDING' AND state = 'NATION_7'", ["first_name"])
bill("p_bill_q15", "hcpcs = '1-URGENT' AND city IN ('BUILDING', 'MACHINERY') AND state = 'NATION_7'", ["first_name"], avg_diff=DIFF)
bill("p_bill_q16", "hcpcs = '1-URGENT' AND city IN ('BUILDING', 'MACHINERY') AND state = 'NATION_7'", ["last_name"], avg_diff=DIFF)
bill("p_bill_q17", "hcpcs = '1-URGENT' AND first_name = 'F' AND city = 'BUILDING' AND state = 'NATION_7'", ["hcpcs"], **FOUR)
bill("p_bill_q18", "hcpcs = '1-URGENT' AND first_name = 'F' AND state = 'NATION_7'", ["hcpcs"], **FOUR)
bill("p_bill_q20", "hcpcs = '1-URGENT' AND state = 'NATION_7'", ["npi", "city", "npi"], lo="min:hcpcs", hi="max:hcpcs", avg_diff=DIFF)
bill("p_bill_q21", "city IN ('BUILDING', 'MACHINERY') AND state = 'NATION_7' AND hcpcs = '1-URGENT'", ["city", "first_name", "last_name", "state"], c1="min:city", c2="min:city", s1="min:state", s2="min:state", st1="max:last_name", st2="min:last_name", z1="min:npi:int", z2="max:npi:int", **FOUR)
# texts that the benchmark repeats
from siltstone.queries.base import ORACLES, QUERIES  # noqa: E402

for again, first in (("q06", "q01"), ("q10", "q04"), ("q11", "q09"), ("q12", "q03"), ("q13", "q08"), ("q14", "q07"), ("q19", "q18"), ("q22", "q21")):
    QUERIES[f"p_bill_{again}"], ORACLES[f"p_bill_{again}"] = QUERIES[f"p_bill_{first}"], ORACLES[f"p_bill_{first}"]


@q("d1_star_flatten", f"WITH {LINEORDER_SQL} SELECT count(*) AS rows, CAST(sum(lo_revenue) AS DOUBLE) AS revenue, CAST(0 AS BIGINT) AS unmatched FROM lineorder_flat")
def d1(s, d):
    lost = unmatched(table(s, d, "lineitem"), table(s, d, "part"), "l_partkey", "p_partkey").agg(F.count(F.lit(1)).alias("unmatched"))
    total = lineorder_flat(s, d).agg(F.count(F.lit(1)).alias("rows"), F.sum("lo_revenue").cast("double").alias("revenue"))
    return total.join(F.broadcast(lost), how="cross")


#: DuckDB names a repeated output column anew; the query returns it once.
ORACLES["p_bill_q20"] = ORACLES["p_bill_q20"].replace("SELECT npi, city, npi,", "SELECT npi, city,")
