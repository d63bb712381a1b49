"""All registered queries of this subpackage and their SQL."""

from tidemark.llm import decontaminate, language, licenses, main_text, manifest, near_duplicates, packing, periodic, quality, secrets, shards, surrogates, top_k  # noqa: F401
from tidemark.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
