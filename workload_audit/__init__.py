"""Spark-native workload audit: ranked findings over a database's query log,
part log and part/merge snapshots, as ordinary DataFrame plans."""

from .config import AuditConfig, fixture_config
from .sources.logs import LogTables, read_log_tables

__all__ = ["AuditConfig", "LogTables", "fixture_config", "read_log_tables"]
