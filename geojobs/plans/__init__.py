"""End-to-end jobs, fixtures and the registered queries with their oracle SQL."""
