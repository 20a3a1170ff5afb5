"""gridloom: sparse metric-cube analytics on PySpark."""
