"""Views over the input tables and the catalogue of runnable queries."""
