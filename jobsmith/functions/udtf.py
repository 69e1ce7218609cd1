"""Extraction as a table function of SQL, ``LATERAL extract_cards(html, config)``."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

CARD_ROWS = "card_rank int, card_no int, title string, company string, location string, salary string, description string, href string"
_FIELDS = ("title", "company", "location", "salary", "description")


class ExtractCards:
    """One row a card of a page that has a title; ``config`` is a source's selectors by field as JSON (constant or a column).

    Texts are those of H2 (first present field by rank, blanks collapsed) and ``href`` is that of H4 as it stands.
    """

    def __init__(self) -> None:
        self.plans: dict = {}

    def eval(self, html: str, config: str) -> Iterator[tuple]:
        from jobsmith.operators.html import PagePlan

        if config not in self.plans:
            named = json.loads(config)
            self.plans[config] = PagePlan(cards=named.pop("job_card", []), card_fields=named)
        _, _, cards, _, _ = self.plans[config].page(html)
        for card in cards:
            first: dict = {}
            for m in card["found"]:  # ranks come in order
                first.setdefault(m["field"], m)
            texts = [" ".join("".join(first[f]["parts"]).split()) if f in first else "" for f in _FIELDS]
            if not texts[0]:
                continue
            hrefs = [m["href"] if m["tag"] == "a" else m["inner_href"] for m in card["found"] if m["field"] == "title"]
            yield (card["card_rank"], card["card_no"], *texts, next((h for h in hrefs if h), ""))


def register(spark: SparkSession, name: str = "extract_cards") -> None:
    """Makes the function known to the session's SQL (rows travel in Arrow batches)."""
    spark.udtf.register(name, udtf(ExtractCards, returnType=CARD_ROWS, useArrow=True))
