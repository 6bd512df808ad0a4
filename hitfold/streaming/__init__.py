"""Structured Streaming jobs: the live feed and resumable history loads."""
