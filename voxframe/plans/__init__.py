"""Compositions: adapters over the given tables, named workflows and the query catalog."""
