"""Streams of orders."""
