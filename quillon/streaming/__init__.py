"""The stateful operators on Structured Streaming."""
