"""citeloom: bibliographic record linkage and analytics on PySpark."""
