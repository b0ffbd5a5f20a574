"""Inputs that the queries derive from the given tables, in SQL that Spark and DuckDB read alike; they grow with the tables.

Braces name the tables an input comes from.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

ROOT = "o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-06-01 00:00:00'"
TIGHT = "o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-07-20 00:00:00'"
SALT = "a salt that a job is given"

_T = "CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING)"
_SLOT = "(p_partkey % 8)"

#: A catalog of columns, eight to a table, out of the rows of part.
COLUMNS = f"""
SELECT 't' || {_T} AS table_name,
  CASE {_SLOT} WHEN 0 THEN 'Id' WHEN 1 THEN 'Email__c' WHEN 2 THEN 'MobilePhone' WHEN 3 THEN 'MailingAddress' WHEN 4 THEN 'Postal_Code__c'
    WHEN 5 THEN 'ExternalId__c' WHEN 6 THEN 'LegacyKey__c' ELSE 'CreatedDate' END AS column_name,
  CASE WHEN p_size % 10 = 0 THEN 'Patient ' || p_name ELSE p_name END AS label,
  CASE WHEN {_SLOT} = 0 THEN 'id' WHEN {_SLOT} = 7 THEN 'datetime' WHEN p_size % 11 = 0 THEN 'boolean' WHEN {_SLOT} = 1 AND p_size % 3 = 0 THEN 'email'
    WHEN {_SLOT} = 2 AND p_size % 2 = 0 THEN 'phone' ELSE 'string' END AS type,
  p_size % 4 <> 0 AS nillable, p_size % 13 = 0 AS calculated, p_size % 9 = 0 AS defaulted, (p_size % 5 <> 0 AND {_SLOT} <> 0) AS createable,
  CAST(10 + p_size AS BIGINT) AS length, {_SLOT} IN (5, 6) AS external_id, p_size % 2 = 0 AS is_unique, p_size % 3 <> 0 AS id_lookup,
  p_size % 17 = 0 AS auto_number, {_SLOT} = 3 AND p_size % 6 = 0 AS master_detail, CAST(p_partkey AS BIGINT) AS pos
FROM {{part}}"""

#: The same catalog on the target: columns and tables are missing, some are shorter.
TARGET_COLUMNS = f"""
SELECT table_name, column_name, label, type, nillable, calculated, defaulted, createable, CASE WHEN pos % 3 = 0 THEN length - 5 ELSE length END AS length,
  external_id, is_unique, id_lookup, auto_number, master_detail, pos
FROM ({COLUMNS}) c WHERE pos % 10 <> 3 AND CAST(floor(pos / 8) AS BIGINT) % 7 <> 3"""

#: Foreign keys between the tables of the catalog: to table n / 2, to a neighbour and back, to itself, and polymorphic ones.
_N = "CAST(floor(p_partkey / 8) AS BIGINT)"
REFERENCES = f"""
SELECT 't' || {_T} AS src, 'f' || CAST({_SLOT} AS STRING) AS field, p_size % 4 <> 0 AS nillable, {_SLOT} = 1 AND p_size % 6 = 0 AS master_detail,
  't' || CAST(CASE {_SLOT} WHEN 1 THEN CAST(floor({_N} / 2) AS BIGINT) WHEN 2 THEN {_N} + 1 - 2 * ({_N} % 2) WHEN 3 THEN {_N} ELSE CAST(floor({_N} / 3) AS BIGINT) END AS STRING) AS target1,
  CASE WHEN {_SLOT} = 4 THEN 't' || CAST(CAST(floor({_N} / 5) AS BIGINT) AS STRING) END AS target2, CAST(p_partkey AS BIGINT) AS pos
FROM {{part}} WHERE {_SLOT} BETWEEN 1 AND 4 AND ({_SLOT} <> 2 OR p_size % 3 <> 0) AND ({_SLOT} <> 3 OR p_size % 5 = 0)"""

EDGES = f"""
SELECT src, dst, field, nillable AND NOT master_detail AS nillable, master_detail, polymorphic, CASE WHEN src = dst THEN 'self' ELSE 'parent' END AS kind, pos FROM (
  SELECT src, target1 AS dst, field, nillable, master_detail, target2 IS NOT NULL AS polymorphic, pos FROM ({REFERENCES}) a
  UNION ALL SELECT src, target2, field, nillable, master_detail, TRUE, pos FROM ({REFERENCES}) b WHERE target2 IS NOT NULL) e"""

#: An id map of customers that lacks every third one.
PARTIAL_MAP = "SELECT 'customer' AS object, CAST(c_custkey AS STRING) AS source_id, 'C' || CAST(c_custkey AS STRING) AS target_id FROM {customer} WHERE c_custkey % 3 <> 0"

#: A target that has some of the customers already, under ids of its own.
TARGET_CUSTOMERS = "SELECT c_name AS name, 'T' || CAST(c_custkey AS STRING) AS id, c_acctbal + 1 AS acctbal, c_mktsegment AS segment FROM {customer} WHERE c_custkey % 4 = 0"

#: Customers name their first order, orders their customer and an earlier order: a cycle between tables and chains within one.
HIERARCHY = {
    "nation": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM {nation}",
    "customer": """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, first_order FROM {customer}
      LEFT JOIN (SELECT o_custkey, min(CAST(o_orderkey AS BIGINT)) AS first_order FROM {orders} GROUP BY o_custkey) f ON o_custkey = c_custkey""",
    "orders": """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderdate, o_orderstatus,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) END AS parent_order FROM {orders}""",
}

#: A load log, one row per event.
LOG = """
SELECT CAST(event_id AS STRING) AS source_id, CASE WHEN event_id % 3 = 0 THEN 'customer' ELSE 'orders' END AS table_name,
  CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'already-loaded' ELSE 'inserted' END AS outcome,
  CASE WHEN event_id % 5 <> 0 THEN NULL WHEN event_id % 2 = 0 THEN 'DUPLICATE_VALUE' ELSE 'FIELD_INTEGRITY' END AS status_code, CAST(400 + event_id % 4 AS BIGINT) AS status,
  CASE WHEN event_id % 10 = 0 THEN '[{{"errorCode":"DUPLICATE_VALUE","message":"duplicates record with id: ' || substr('003A0000012345678Zz' || CAST(event_id AS STRING), 1, CASE WHEN event_id % 20 = 0 THEN 18 ELSE 15 END) || ' x"}}]'
    WHEN event_id % 5 = 0 THEN '[{{"errorCode" : "FIELD_INTEGRITY"}},{{"error":"E_' || event_type || '"}},{{"errorCode":"not a code"}}]' ELSE '' END AS message
FROM {events}"""


def names_in(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The SQL over the tables of a folder."""
    names = names_in(sql)
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def plain(sql: str) -> str:
    """The SQL with bare table names, as the checks run it."""
    return sql.format(**{n: n for n in names_in(sql)})
