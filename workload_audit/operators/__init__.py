"""The audit checks and stand-alone operator queries."""
