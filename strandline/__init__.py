"""Panel research, portfolio analytics and training-data preparation on Spark."""
