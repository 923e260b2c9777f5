"""Graph operators over edge-list DataFrames."""
