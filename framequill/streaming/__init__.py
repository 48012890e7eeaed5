"""Stateful processing of events."""
