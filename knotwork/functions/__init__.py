"""Column functions: semirings, functors, seeded random numbers."""
