"""Structured Streaming: live panels, windowed counts, sessions, incremental export."""
