"""Part of the marketloom engine."""
