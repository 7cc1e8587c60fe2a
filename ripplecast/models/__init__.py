"""Feature building, selection, balancing, model fitting and evaluation."""
