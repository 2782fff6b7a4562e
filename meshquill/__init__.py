"""Mesh morphometrics and rating analytics expressed as Spark plans."""
