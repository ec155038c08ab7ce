"""Tables and file sources."""
