"""Word lists in, reports and responses out."""
