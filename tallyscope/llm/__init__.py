"""Operators for building and checking training corpora.

Functions that run on executors are sent by value, so workers need not have the package installed.
"""
from pyspark import cloudpickle

import tallyscope

cloudpickle.register_pickle_by_value(tallyscope)
