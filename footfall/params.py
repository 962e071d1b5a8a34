"""Parameters of an analysis task."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass


def _text(value: object) -> str | None:
    if value is None or str(value) == "":
        return None
    return str(value)


def _items(value: object) -> tuple[str, ...] | None:
    text = _text(value)
    return tuple(text.split(",")) if text is not None else None


def _number(value: object) -> int | None:
    text = _text(value)
    return int(text) if text is not None else None


@dataclass(frozen=True)
class TaskParams:
    """What to analyse. A missing field leaves its condition out."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None
    target_page_flow: tuple[int, ...] | None = None
    cycle: str | None = None

    @classmethod
    def from_mapping(cls, raw: Mapping[str, object]) -> TaskParams:
        """Build from the JSON keys of a task record; lists are comma separated."""
        categories = _items(raw.get("categoryIds"))
        flow = _items(raw.get("targetPageFlow"))
        return cls(
            start_date=_text(raw.get("startDate")),
            end_date=_text(raw.get("endDate")),
            start_age=_number(raw.get("startAge")),
            end_age=_number(raw.get("endAge")),
            professionals=_items(raw.get("professionals")),
            cities=_items(raw.get("cities")),
            sex=_text(raw.get("sex")),
            keywords=_items(raw.get("keywords")),
            category_ids=tuple(int(c) for c in categories) if categories else None,
            target_page_flow=tuple(int(p) for p in flow) if flow else None,
            cycle=_text(raw.get("cycle")),
        )

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        return cls.from_mapping(json.loads(text))
