"""Check registry, multi-check runner, report tables and sinks."""
