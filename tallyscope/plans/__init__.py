"""End-to-end jobs and case queries built from the operators."""
