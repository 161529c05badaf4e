"""Behaviour analytics over audit, object-access and flow logs as Spark DataFrame operators."""
