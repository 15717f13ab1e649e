"""Operators: functions of DataFrames and a Config."""
