"""Job streams."""
