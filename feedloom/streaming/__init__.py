"""Landing folders read as streams."""
