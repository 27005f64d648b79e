"""Whole runs: the document pipeline, its command line, and the registered queries."""
