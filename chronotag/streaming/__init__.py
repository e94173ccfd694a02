"""Streaming builds."""
