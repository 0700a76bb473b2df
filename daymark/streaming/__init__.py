"""Structured Streaming jobs that keep user-day features up to date."""
