"""Support-ticket triage and evaluation on Spark DataFrames."""
