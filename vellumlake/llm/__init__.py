"""Operators for training-data corpora.  Nothing outside this package imports it.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

from . import htmlscore, lblm, merkle, omh, packing, pii, quality, scratch, substrings, textvec, tokentree, wumanber

for _m in (textvec, substrings, omh, scratch, quality, wumanber, merkle, packing, pii, htmlscore, lblm, tokentree):
    cloudpickle.register_pickle_by_value(sys.modules[_m.__name__])
