"""The same operators on tables that grow: Structured Streaming where state is bounded."""
