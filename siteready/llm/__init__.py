"""Training-data operators: each module has one operator; ``queries`` registers one query for each."""
