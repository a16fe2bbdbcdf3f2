"""Evaluation of binary classifiers on Spark tables.

Folds, scaling, fuzzy memberships, model scores, ROC statistics and the tables
that report them, all as DataFrame jobs keyed by dataset, model and fold.
"""
