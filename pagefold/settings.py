"""What a run may switch, in one place instead of the environment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagefold.functions import catalog
from pagefold.operators import refine
from pagefold.sources import parsing


@dataclass(frozen=True)
class Settings:
    """refiner: spans by their types' rules; guard: no word is lost that is no label; validator: scores by format; default: score of an answer without one."""

    refiner: bool = True
    guard: bool = False
    validator: bool = True
    default: float = 0.8


def fields(responses: DataFrame, words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docid, page, ord, fieldtype, l, t, r, b, score, line_item_id of answers (docid, page, raw) about pages' words."""
    found = parsing.answers(responses, catalog.KILE + catalog.LIR, settings.default)
    out = refine.resolve(found, words, settings.refiner, settings.guard)
    if settings.validator:
        return out
    return out.drop("score").join(found.select("docid", "page", "ord", "score"), ["docid", "page", "ord"]).select(out.columns)
