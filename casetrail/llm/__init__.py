"""Operators of a training-data pipeline: filtering, scoring, de-duplication, sanitising, packing and archives."""
