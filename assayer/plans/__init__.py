"""Whole jobs: describing, running and scoring an evaluation."""
