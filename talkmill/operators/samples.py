"""A user-defined aggregator as an example."""

from __future__ import annotations

import json
from typing import Any


class SumOfScores:
    """Sum of integer scores and number of records."""

    def __init__(self, total: int = 0, records: int = 0):
        self.total, self.records = total, records

    def ingest(self, record: dict[str, Any]) -> None:
        s = record.get("score")
        self.total += s if isinstance(s, int) and not isinstance(s, bool) else 0
        self.records += 1

    def merge(self, other: SumOfScores) -> None:
        self.total += other.total
        self.records += other.records

    def to_json(self) -> str:
        return json.dumps([self.total, self.records])

    @staticmethod
    def from_json(s: str) -> SumOfScores:
        return SumOfScores(*json.loads(s))
