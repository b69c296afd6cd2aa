"""All queries of this subpackage."""

from . import (  # noqa: F401
    decontamination, fingerprints, html_text, language, licenses, mixing, passages, privacy, quality, reversed_search, shingle_join,
    spelling, warc,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
