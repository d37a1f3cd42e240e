"""Tournaments of chunking strategies, saved plans and pipeline adapters."""
