"""tillkit: multi-tenant billing analytics as Spark DataFrame transforms.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built from
Spark's own primitives (no Python UDF), so Catalyst can push filters into the
parquet scan, prune columns, pick join strategies and run partial
aggregation before every shuffle.

Sub-packages:

* ``sources``   -- table readers/writers, the binding of the driver's parquet
  tables to billing tables, fixed seed rows.
* ``functions`` -- column-expression builders (exact decimal pricing,
  predicates, text formats, PostgreSQL NULL ordering).
* ``operators`` -- pricing, reports, listings, access joins, table
  maintenance, data quality, generators.
* ``plans``     -- named query plans over the bound tables and their DuckDB
  oracle SQL.
* ``streaming`` -- Structured Streaming forms of daily sales and posting.
"""

from tillkit.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
