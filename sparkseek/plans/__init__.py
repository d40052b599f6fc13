"""The document model, filters, and the planner from requests to DataFrames."""
