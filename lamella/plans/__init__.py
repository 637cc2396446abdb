"""Model types and metric queries."""
