"""Training-data pipeline operators: one module for each, their queries in queries.py, their SQL in oracle.py."""
