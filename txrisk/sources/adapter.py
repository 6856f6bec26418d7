"""Driver tables -> transaction table.

The test data has no transaction table, so a view named ``tx`` is derived
from ``orders``, ``customer`` and ``supplier``: one transaction per order. It
only gives rows in the transaction schema; the engine's jobs take nothing
from how it is made. The same SQL (dialect words swapped) is the first CTE of
every oracle query, so both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Balances are scaled by 64 (a power of two) so no rounding differs between
# engines. The supplier of an order is chosen by an equi-join on a key computed
# from the order key; min/count come from scalar subqueries (no cross join).
_TX_SQL = """
WITH base AS (
  SELECT o.o_orderkey AS row_id, {days} AS step,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
      WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'DEBIT' ELSE 'CASH_IN' END AS type,
    o.o_totalprice AS amount,
    concat('C', CAST(o.o_custkey AS {s})) AS nameOrig,
    greatest(c.c_acctbal, CAST(0 AS DOUBLE)) * 64 AS oldbalanceOrg,
    concat('M', CAST(s.s_suppkey AS {s})) AS nameDest,
    CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE)
         ELSE greatest(s.s_acctbal, CAST(0 AS DOUBLE)) * 64 END AS oldbalanceDest,
    o.o_orderstatus AS st
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = {k0} + o.o_orderkey % {n})
SELECT row_id, CAST(step AS INT) AS step, type, amount, nameOrig, oldbalanceOrg,
  CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount
       ELSE greatest(oldbalanceOrg - amount, CAST(0 AS DOUBLE)) END AS newbalanceOrig,
  nameDest, oldbalanceDest,
  CASE WHEN st = 'F' AND type IN ('TRANSFER','CASH_OUT') THEN oldbalanceDest
       ELSE oldbalanceDest + amount END AS newbalanceDest,
  CAST(CASE WHEN type IN ('TRANSFER','CASH_OUT') AND st = 'F' AND amount > 350000
       THEN 1 ELSE 0 END AS INT) AS isFraud,
  CAST(CASE WHEN type = 'TRANSFER' AND st = 'F' AND amount > 490000
       THEN 1 ELSE 0 END AS INT) AS isFlaggedFraud
FROM base
"""

SPARK_DIALECT = {
    "days": "datediff(CAST(o.o_orderdate AS DATE), DATE'1995-01-01')",
    "s": "STRING",
}
DUCKDB_DIALECT = {
    "days": "date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE))",
    "s": "VARCHAR",
}

SOURCE_TABLES = ("orders", "customer", "supplier")


SUBQUERIES = {"k0": "(SELECT min(s_suppkey) FROM supplier)", "n": "(SELECT count(*) FROM supplier)"}


def tx_sql(dialect: str = "spark", k0=None, n=None) -> str:
    """The adapter SQL; supplier min/count as scalar subqueries unless given."""
    words = dict(SPARK_DIALECT if dialect == "spark" else DUCKDB_DIALECT)
    words["k0"] = SUBQUERIES["k0"] if k0 is None else str(int(k0))
    words["n"] = SUBQUERIES["n"] if n is None else str(int(n))
    return _TX_SQL.format(**words)


_SOURCES: dict = {}


def register_sources(spark: SparkSession, sf_dir: str) -> dict:
    """Temp views over the three source tables; the readers (file listing,
    schema) and the two supplier scalars are made once per session and folder."""
    key = (id(spark), sf_dir)
    if key not in _SOURCES or _SOURCES[key][2] is not spark:
        frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCE_TABLES}
        r = frames["supplier"].agg(F.min("s_suppkey").alias("k0"), F.count(F.lit(1)).alias("n")).first()
        _SOURCES[key] = (frames, (r["k0"], r["n"]), spark)
    frames, scalars, _ = _SOURCES[key]
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return {"k0": scalars[0], "n": scalars[1]}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``tx`` table for one scale-factor folder.

    The two supplier scalars are read once per session and folder (one tiny
    aggregate) and inlined, so jobs over ``tx`` do not re-run them as
    subqueries.
    """
    r = register_sources(spark, sf_dir)
    df = spark.sql(tx_sql("spark", r["k0"], r["n"]))
    df.createOrReplaceTempView("tx")
    return df


def oracle_with_tx(body: str) -> str:
    """Prefix an oracle query with the DuckDB form of the ``tx`` view as a CTE.

    ``body`` may start with further CTEs (``, name AS (...)``) or a SELECT.
    """
    inner = tx_sql("duckdb").strip()
    body = body.strip()
    if body.startswith(","):
        return f"WITH tx AS (\n{inner}\n){body}"
    return f"WITH tx AS (\n{inner}\n)\n{body}"
