"""End-to-end jobs, test fixtures and the query registry."""
