"""sparkloom: tables, statistics, models and vector search as PySpark plans."""
