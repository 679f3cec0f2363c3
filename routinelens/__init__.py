"""Behaviour analytics for event histories, declared as Spark DataFrame plans."""
