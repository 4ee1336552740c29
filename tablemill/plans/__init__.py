"""Compositions: step lists, whole curation jobs, and the registered queries."""
