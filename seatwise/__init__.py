"""Admission-cutoff analytics as Spark DataFrame operators."""
