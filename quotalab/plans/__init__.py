"""Whole analyses: layers in order, models, audit."""
