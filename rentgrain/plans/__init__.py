"""The registered queries and their statements in plain SQL."""
