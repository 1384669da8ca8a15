"""Composed jobs: feature matrix, training and verification reports."""
