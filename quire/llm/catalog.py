"""Imports every query module of this subpackage; they register on import."""

from . import (ann, embedding_dedup, line_dedup, lm_score, merkle, minhash_dedup, mixing, piece_codec,  # noqa: F401
               sharding, token_counts, token_files, toxicity, vector_codes)
from .common import ORACLE_SQL, QUERIES, prepare  # noqa: F401
