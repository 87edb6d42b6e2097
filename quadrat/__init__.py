"""Spark-native operators that turn raw occurrence tables into publishable Darwin Core data."""
