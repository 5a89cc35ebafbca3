"""Relational analytics on Spark: typed schemas, a fluent query builder, and a catalogue of analytical queries."""
