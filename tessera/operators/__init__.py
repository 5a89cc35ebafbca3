"""The fluent query builder and the operators behind it."""
