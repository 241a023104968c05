"""Training-data operators: ten corpus-cleaning jobs, their queries and their oracle SQL."""
