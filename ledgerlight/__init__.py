"""Pricing-summary analytics on PySpark: exact, declarative, shuffle-light."""
