"""Event-sourced property graphs and corpus preparation on Spark."""
