"""marlstone: analytics over market-style panel tables, written for Spark."""
