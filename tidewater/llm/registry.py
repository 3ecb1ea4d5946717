"""Queries of this subpackage and the SQL that the driver may hold them against."""

from __future__ import annotations

from . import chunks, conversations, languages, licenses, neardup, packing, quality, secrets, segmentation, sharding, spelling, suffixes, vectors

MODULES = [secrets, neardup, packing, segmentation, quality, sharding, suffixes, chunks, licenses, vectors, spelling, languages, conversations]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
