"""The index as a whole, its queries and comparisons."""
