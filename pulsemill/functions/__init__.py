"""Scalar functions over columns, gathered from the operators they belong to."""

from ..operators.cooccurrence import pmi
from ..operators.fingerprints import hamming, hour_bucket, simhash64
from ..operators.hotness import align_to_quarter, growth, score
from ..operators.normalize import clean_text
from ..operators.render import bar, markdown_escaped, percent

__all__ = ["align_to_quarter", "bar", "clean_text", "growth", "hamming", "hour_bucket", "markdown_escaped", "percent", "pmi", "score", "simhash64"]
