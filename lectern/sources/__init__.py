"""Where documents come from, and settings."""
