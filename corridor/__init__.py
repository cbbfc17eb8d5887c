"""Spark-first engine for driving-plan data: operators, sources, functions, plans and streams."""
