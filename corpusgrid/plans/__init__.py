"""Shared logical plans: concepts, postings and query texts."""
