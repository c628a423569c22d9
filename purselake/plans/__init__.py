

from purselake.plans import registry  # noqa: E402, F401  (loads all of them, in an order that holds)
