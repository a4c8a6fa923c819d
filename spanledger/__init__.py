"""Subscription-lifecycle analytics as Spark DataFrame operators."""
