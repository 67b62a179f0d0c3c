"""Job registry, oracle SQL and plan checks."""
