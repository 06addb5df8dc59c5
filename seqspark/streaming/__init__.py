"""Micro-batch forms of the batch jobs."""
