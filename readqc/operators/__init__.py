"""Trimming, filtering, metrics and rules, each from DataFrame to DataFrame."""
