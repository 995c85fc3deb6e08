"""Readers and writers for the formats the catalogue is fed from."""
