"""Plans: the end-to-end job and the named queries."""
