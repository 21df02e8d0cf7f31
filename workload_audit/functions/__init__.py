"""Reusable Column and grouped-aggregate helpers."""
