"""Column functions: money, geography, time, strings."""
