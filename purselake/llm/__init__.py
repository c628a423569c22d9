"""Operators for preparing training corpora.

Nothing else in ``purselake`` imports this subpackage; ``registry`` lists its
queries and their SQL for the driver.
"""
