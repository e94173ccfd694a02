"""Builds, queries and relations over points and intervals."""
