"""Column functions over one event."""
