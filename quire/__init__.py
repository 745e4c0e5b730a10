"""Quire: captured web pages to ordered books, and the tables behind them, on PySpark."""
