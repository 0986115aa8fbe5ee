"""Athlete-performance analytics as Spark DataFrame operators."""
