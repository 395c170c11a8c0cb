"""Registered queries and whole-pipeline plans."""
