"""tickloom: analytics on binary market-data feeds with Spark."""
