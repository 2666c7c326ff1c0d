"""Targets and the streams that feed them."""
