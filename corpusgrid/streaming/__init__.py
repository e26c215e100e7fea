"""Micro-batch forms of the incremental operators."""
