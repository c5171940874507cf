"""brasswork: retail analytics operators as plain functions from DataFrame to DataFrame."""
