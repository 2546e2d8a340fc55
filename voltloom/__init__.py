"""Spark table operators for hourly electricity-price analytics over many bidding zones."""
