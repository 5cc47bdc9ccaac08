"""kvlog: change-log analytics on Spark."""
