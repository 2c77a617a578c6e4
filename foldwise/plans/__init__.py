"""Whole analyses built from the operators, and the options they share."""
