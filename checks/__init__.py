"""Every operator on the driver tables, next to independent SQL for the same result."""
