"""Payloads, files and sinks."""
