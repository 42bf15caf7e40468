"""Streams: progress logs as a source, incremental catalogs as a sink."""
