"""PySpark operators for contest data: leakage-safe features, quotes, decisions and evaluation."""
