"""Operators on DataFrames: sequences, rings, routes, lineage, rules, ledgers, requests, pixels."""
