"""Whole plans: profiles, hybrid search, the benchmark run, and the registered queries."""
