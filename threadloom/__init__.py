"""Spark-first analytics over conversation archives and the knowledge distilled from them."""
