"""Shared column and plan helpers."""
