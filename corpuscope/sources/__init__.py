"""Where logical tables come from."""
