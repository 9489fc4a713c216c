"""Readers, landing zone and model store."""
