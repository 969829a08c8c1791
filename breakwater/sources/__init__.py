"""Scans of the input formats, and the output sinks."""
