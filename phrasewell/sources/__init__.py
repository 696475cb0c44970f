"""Configuration and stored index tables."""
