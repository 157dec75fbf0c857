"""Streaming twins of sequential operators. The batch operators remain the reference; a replay gives equal rows."""
