"""Views of the star-schema tables as shopper, quote, loss, passenger, sky and score tables.

Each view is one SELECT that Spark and a reference SQL engine both read, so that queries and their checks start from the
same rows. Names in braces are other views or base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]

VIEWS = {
    "transactions": """
        SELECT o_custkey AS id, s_nationkey AS chain, p_type AS category, split_part(p_name, ' ', 2) AS company, p_brand AS brand,
          CAST(o_orderdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
          CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END * (1 - l_discount) AS amount,
          l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "baskets": "SELECT o_orderkey AS basket, o_custkey AS id, CAST(o_orderdate AS DATE) AS date FROM {orders}",
    "products": "SELECT p_partkey AS product, p_type AS category, split_part(p_name, ' ', 2) AS company, p_brand AS brand FROM {part}",
    "lines": """
        SELECT l_orderkey AS basket, l_partkey AS product, l_suppkey AS seller, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
          CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END * (1 - l_discount) AS amount FROM {lineitem}""",
    "sellers": "SELECT s_suppkey AS seller, s_nationkey AS chain FROM {supplier}",
    "offers": """
        SELECT p_partkey AS offer, p_type AS category, split_part(p_name, ' ', 2) AS company, p_brand AS brand,
          1 + p_size % 3 AS quantity, p_retailprice / 100 AS offervalue FROM {part} WHERE p_partkey % 40 = 0""",
    "asked": """
        SELECT c_custkey AS id, c_nationkey AS chain, c_mktsegment AS market, 40 * (c_custkey % (SELECT count(*) FROM {offers})) AS offer,
          DATE '1999-01-01' + CAST(c_custkey % 60 AS INT) AS offerdate FROM {customer}""",
    "trips": """
        SELECT a.id, count(DISTINCT CAST(o_orderdate AS DATE)) AS trips FROM {asked} a JOIN {orders} ON a.id = o_custkey
        WHERE CAST(o_orderdate AS DATE) > a.offerdate AND CAST(o_orderdate AS DATE) <= a.offerdate + 365 GROUP BY a.id""",
    "history": """
        SELECT a.id, a.chain, a.market, a.offer, a.offerdate, coalesce(t.trips, 0) AS repeattrips,
          CASE WHEN coalesce(t.trips, 0) > 0 THEN 't' ELSE 'f' END AS repeater FROM {asked} a LEFT JOIN {trips} t ON a.id = t.id""",
    "quotes": """
        SELECT user_id AS customer_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shopping_pt,
          CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS record_type,
          value AS cost, k, k % 3 AS a, k % 2 AS b, 1 + k % 4 AS c, 1 + k % 3 AS d, CAST(floor(k / 2) AS INT) % 2 AS e,
          CAST(floor(k / 3) AS INT) % 4 AS f, 1 + CAST(floor(k / 5) AS INT) % 4 AS g,
          CASE event_type WHEN 'view' THEN 'a' WHEN 'signup' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'error' THEN 'd' ELSE 'e' END AS car_value,
          CASE WHEN k % 5 = 0 THEN NULL ELSE 1 + k % 4 END AS risk_factor, 18 + k AS age_oldest
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e""",
    "loss": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS target,
          CASE WHEN l_partkey % 11 = 0 THEN 'Z' ELSE p_type END AS var4, p_size % 7 AS var8, l_tax AS var10, l_quantity AS var11,
          l_discount AS var13, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS var15
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "passengers": """
        SELECT c_custkey AS id, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS survived, 1 + c_nationkey % 3 AS pclass,
          CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE abs(c_acctbal) / 100 END AS fare,
          substr(c_mktsegment, 1, 1) AS embarked, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 1 + c_custkey % 80 END AS age FROM {customer}""",
    "skies": """
        SELECT user_id AS sky_id, event_id AS galaxy, CAST((event_id * 37) % 4200 AS DOUBLE) AS x, CAST((event_id * 101) % 4200 AS DOUBLE) AS y,
          (k - 50) / 100.0E0 AS e1, (event_id % 100 - 50) / 100.0E0 AS e2
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e""",
    "halo_counts": "SELECT DISTINCT sky_id, 1 + sky_id % 3 AS n_halos FROM {skies}",
    "pixels": """
        SELECT vec_id AS image_id, CAST(floor(p / 8) AS INT) AS r, p % 8 AS c,
          least(greatest(round(255 * (0.8E0 + 2 * e)), 0.0E0), 255.0E0) AS v FROM {cells}""",
    "scores": """
        SELECT d.doc_id AS id, l.quality AS y, l.toxic AS toxic, CAST(d.n_chars AS DOUBLE) AS score, CAST(1 + d.doc_id % 3 AS DOUBLE) AS weight
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}
#: One row for each element of an embedding: the two engines spell this differently.
CELLS = {
    "spark": "SELECT vec_id, label, CAST(p AS INT) AS p, CAST(e AS DOUBLE) AS e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS p, e",
    "sql": "SELECT vec_id, label, CAST(unnest(range(64)) AS INT) AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM {embeddings}",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, over the parquet files in sf_dir."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = CELLS["spark"] if name == "cells" else VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})


def as_sql(query: str) -> str:
    """The query, in which views stand in braces, with the views it needs as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n not in BASE and n not in order:
                add(CELLS["sql"] if n == "cells" else VIEWS[n])
                order.append(n)

    add(query)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    parts = ",\n".join(f"{n} AS ({plain(CELLS['sql'] if n == 'cells' else VIEWS[n])})" for n in order)
    own = plain(query)
    for head in ("WITH RECURSIVE ", "WITH "):
        if parts and own.startswith(head):
            return f"{head}{parts},\n{own.removeprefix(head)}"
    return (f"WITH {parts}\n" if parts else "") + own


#: Both engines' results are compared at so many significant digits, or decimal places if those are fewer: fine enough to tell values
#: apart, coarse enough for sums in another order.
DIGITS = 12


def rounded(df: DataFrame, columns: list[str], places: int) -> DataFrame:
    """df with columns as doubles of DIGITS significant digits, at most `places` of them decimal."""

    def one(c: str) -> Column:  # as text: a call for each column, not for each function
        x = f"CAST(`{c}` AS DOUBLE)"
        scale = f"pow(10D, greatest(0D, least({float(places)}D, {DIGITS - 1} - CAST(floor(log10(abs({x}))) AS DOUBLE))))"
        return F.expr(f"CASE WHEN {x} <> 0 AND NOT isnan({x}) AND abs({x}) <> double('infinity') THEN round({x} * {scale}) / {scale} + 0D ELSE {x} + 0D END")

    return df.withColumns({c: one(c) for c in columns}) if columns else df


def rounded_sql(query: str, columns: list[str], places: int) -> str:
    """The same for a query."""

    def one(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        scale = f"pow(10.0::DOUBLE, greatest(0.0::DOUBLE, least({float(places)}::DOUBLE, {DIGITS - 1} - floor(log10(abs({x}))))))"
        return f"CASE WHEN {x} <> 0 AND isfinite({x}) THEN round({x} * {scale}) / {scale} + 0.0::DOUBLE ELSE {x} + 0.0::DOUBLE END AS {c}"

    return f"SELECT * REPLACE ({', '.join(map(one, columns))}) FROM ({query}) q" if columns else query
