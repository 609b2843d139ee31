"""Composed jobs: feature matrix, experiment, registered queries."""
