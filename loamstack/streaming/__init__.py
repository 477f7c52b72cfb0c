"""Nightly batches as a stream."""
