"""Registered queries, their oracles and the tables they run on."""
