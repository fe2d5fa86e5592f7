"""Dataflow operators over retail transactions."""
