"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from glassine.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: No stage but decontamination can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None
