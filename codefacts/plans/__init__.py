"""Whole jobs: registered queries, collection, snapshots and the query surface."""
