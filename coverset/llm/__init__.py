"""Operators of a training-data pipeline: near duplicates, filters, tokens and shards over document tables."""
