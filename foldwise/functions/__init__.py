"""Column functions: transformations, distribution tails, text formats."""
