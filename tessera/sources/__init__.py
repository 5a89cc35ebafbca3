"""Sources, sinks, the catalog of relations, and their physical layout."""
