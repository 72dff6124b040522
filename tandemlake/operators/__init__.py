"""DataFrame operators on reads, units, overlaps and graphs."""
