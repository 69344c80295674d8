"""Basis families, fitted models and their algebra: small arrays on the driver."""
