"""Readers that turn tables into messages, and sinks for saved checks."""
