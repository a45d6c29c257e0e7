"""Keeping the latest behaviour fresh."""
