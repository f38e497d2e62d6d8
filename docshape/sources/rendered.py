"""A corpus of known types, rendered from the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = {"order": 0, "customer": 1_000_000_000, "part": 2_000_000_000, "supplier": 3_000_000_000}


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``cluster_id`` (the type), ``text``: one key-value document per order, customer, part and supplier."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    key = lambda c, m: F.pmod(F.col(c), F.lit(m))
    kinds = [
        ("order", "orders", "o_orderkey", [
            F.lit("ORDER"), _line("Order Number", F.col("o_orderkey").cast("string")), _line("Order Status", F.col("o_orderstatus")), _line("Total Price", F.concat(F.lit("$"), _money("o_totalprice"))),
            F.when(key("o_orderkey", 5) != 0, _line("Order Date", F.date_format("o_orderdate", "yyyy-MM-dd"))), F.when(key("o_orderkey", 2) == 0, _line("Order Priority", F.col("o_orderpriority")))]),
        ("customer", "customer", "c_custkey", [
            F.lit("CUSTOMER"), _line("Customer Name", F.col("c_name")), _line("Account Balance", _money("c_acctbal")), F.when(key("c_custkey", 4) != 0, _line("Market Segment", F.col("c_mktsegment")))]),
        ("part", "part", "p_partkey", [
            F.lit("PART"), _line("Part Name", F.col("p_name")), _line("Brand", F.col("p_brand")), _line("Retail Price", F.concat(F.lit("$"), _money("p_retailprice"))), F.when(key("p_partkey", 3) != 0, _line("Size", F.col("p_size").cast("string")))]),
        ("supplier", "supplier", "s_suppkey", [F.lit("SUPPLIER"), _line("Supplier Name", F.col("s_name")), _line("Account Balance", _money("s_acctbal"))]),
    ]
    out = None
    for kind, name, id_col, lines in kinds:
        one = read(name).select((F.col(id_col) + _BASE[kind]).cast("long").alias("doc_id"), F.lit(kind).alias("cluster_id"), F.concat_ws("\n", *lines).alias("text"))
        out = one if out is None else out.union(one)
    return out


SQL = r"""
SELECT CAST(o_orderkey AS BIGINT) AS doc_id, 'order' AS cluster_id, concat_ws(chr(10), 'ORDER', 'Order Number: ' || CAST(o_orderkey AS VARCHAR), 'Order Status: ' || o_orderstatus, 'Total Price: $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR),
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Order Date: ' || strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 2 = 0 THEN 'Order Priority: ' || o_orderpriority END) AS text FROM orders
UNION ALL SELECT CAST(c_custkey + 1000000000 AS BIGINT), 'customer', concat_ws(chr(10), 'CUSTOMER', 'Customer Name: ' || c_name, 'Account Balance: ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), CASE WHEN c_custkey % 4 <> 0 THEN 'Market Segment: ' || c_mktsegment END) FROM customer
UNION ALL SELECT CAST(p_partkey + 2000000000 AS BIGINT), 'part', concat_ws(chr(10), 'PART', 'Part Name: ' || p_name, 'Brand: ' || p_brand, 'Retail Price: $' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), CASE WHEN p_partkey % 3 <> 0 THEN 'Size: ' || CAST(p_size AS VARCHAR) END) FROM part
UNION ALL SELECT CAST(s_suppkey + 3000000000 AS BIGINT), 'supplier', concat_ws(chr(10), 'SUPPLIER', 'Supplier Name: ' || s_name, 'Account Balance: ' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR)) FROM supplier
"""
