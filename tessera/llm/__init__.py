"""Operators of a training-data pipeline: language, licences, chat, toxicity, near-duplicates, leaks, mixing, quality."""
