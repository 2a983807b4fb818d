"""Compositions of operators: batch detection, batch generation, detector cascade."""
