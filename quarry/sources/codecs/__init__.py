"""Byte codecs: pure functions on bytes, called from Arrow batches."""
