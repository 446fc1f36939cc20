"""Readers: tables, graph populations derived from them, and network files."""
