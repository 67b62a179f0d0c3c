"""Churn modelling: first-order features, class balancing, models, metrics."""
