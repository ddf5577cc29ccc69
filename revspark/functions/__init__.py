"""revspark."""
