"""DataFrame operators: pricing, numbering, reports, listings, access,
maintenance, quality, aggregates, generators, and the size-checked broadcast."""
