"""Graph operators over node and edge DataFrames."""
