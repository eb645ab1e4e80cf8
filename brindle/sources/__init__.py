"""Object stores and document sources."""
