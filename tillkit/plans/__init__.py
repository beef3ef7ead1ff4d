"""Registered plans and their oracles.

* ``catalog``       -- name -> plan over the bound parquet tables (``queries()``)
* ``sql`` / ``oracle`` -- the same plans as DuckDB SQL (``oracle_sql()``)
* ``posting``       -- the batch invoice posting job (invoices, then stock)
* ``sql_functions`` -- reports and listings as Spark SQL table functions
"""
