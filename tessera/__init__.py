"""Tessera: search, entity and evidence analytics as DataFrame operators on PySpark."""
