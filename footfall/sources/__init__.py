"""Readers: tables, JSON lines, text logs, topics and task records."""
