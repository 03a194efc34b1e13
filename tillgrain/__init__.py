"""tillgrain: retail analytics on Spark."""
