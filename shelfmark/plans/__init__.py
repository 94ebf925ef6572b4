"""End-to-end jobs: search, details, lookup by ISBN, resolution."""
