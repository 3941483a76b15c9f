"""Run configurations and what they are expected to produce."""
