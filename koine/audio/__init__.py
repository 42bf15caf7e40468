"""Waveforms: decoding, metrics and processing, in array operations that run in Arrow batches."""
