"""Training-data operators: each module holds one operator; queries.py registers the thin queries."""
