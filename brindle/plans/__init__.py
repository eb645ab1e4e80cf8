"""Namespaces, query planning and the registered queries."""
