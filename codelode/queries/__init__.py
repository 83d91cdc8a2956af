"""One query per operator over the given tables."""

from . import chunks, contents, index, listings, readers, redaction, repomap, search, store, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunks", "contents", "index", "listings", "readers", "redaction", "repomap", "search", "store", "streams"]
