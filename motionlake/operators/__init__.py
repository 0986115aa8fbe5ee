"""Operators: functions from DataFrame to DataFrame, each for all entities in one job."""
