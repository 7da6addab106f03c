"""Structured Streaming: debounce, incremental update, keyed state."""
