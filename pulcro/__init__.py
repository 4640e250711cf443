"""Data quality, cleansing and rule validation of tables at scale, on PySpark."""
