"""Column expressions used inside the catalog jobs."""
