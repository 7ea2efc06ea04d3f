"""Analytics for posting feeds and operators for training corpora on PySpark."""
