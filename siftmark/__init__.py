"""siftmark: similarity digests and corpus processing on Spark DataFrames."""

from siftmark.functions.compare import compare
from siftmark.functions.lexical import LexicalHasher, SemHasher, digest, parse_digest, similarity, similarity_text
from siftmark.functions.semantic import SemanticHasher, fit_reference_mean, parse_semantic_digest, semantic_digest, semantic_similarity
from siftmark.functions.shingling import normalize

__version__ = "0.1.0"

__all__ = [
    "LexicalHasher",
    "SemHasher",
    "SemanticHasher",
    "__version__",
    "compare",
    "digest",
    "fit_reference_mean",
    "normalize",
    "parse_digest",
    "parse_semantic_digest",
    "semantic_digest",
    "semantic_similarity",
    "similarity",
    "similarity_text",
]
