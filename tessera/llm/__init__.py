"""Operators of a training-data pipeline: mixing, joins, scoring, deduplication, media and archives."""
