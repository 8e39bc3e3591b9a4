from datetime import datetime, timezone

import pytest

from tidewire.operators.instants import found_instants

ARTICLES = "article_id string, source_id string, published_at string, updated_at string"
SOURCES = "source_id string, time_zone string, date_order string"
ZONES = [("waw", "Europe/Warsaw", "DMY"), ("nyc", "America/New_York", "MDY"), ("nul", None, None)]


def epoch(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


CASES = [
    ("waw", "2026-02-10T01:00:00+01:00[Europe/Warsaw]", epoch(2026, 2, 10)),
    ("waw", "2026-02-10T00:00:00.999Z", epoch(2026, 2, 10)),
    ("waw", "20260211T224030Z", epoch(2026, 2, 11, 22, 40, 30)),
    ("waw", "2026-02-10", epoch(2026, 2, 9, 23)),
    ("waw", "10/02/2026 01:00", epoch(2026, 2, 10)),
    ("nyc", "02/10/2026 7:00 PM", epoch(2026, 2, 11)),
    ("nyc", "10.02.2026, 12:00", epoch(2026, 2, 10, 17)),
    ("nyc", "Feb 10, 2026, 12:05 AM", epoch(2026, 2, 10, 5, 5)),
    ("waw", "Opublikowano: 10 lutego 2026, 01:00", epoch(2026, 2, 10)),
    ("waw", "Stand: 1. März 2026, 05:18 Uhr", epoch(2026, 3, 1, 4, 18)),
    ("waw", "Tue, 10 Feb 2026 01:00:00 +0100", epoch(2026, 2, 10)),
    ("waw", "2026-02-10 09:55 EET", epoch(2026, 2, 10, 7, 55)),
    ("waw", "1770681600473", 1770681600),
    # the hour that doesn't exist and the one that occurs twice: the offset before the change holds
    ("waw", "2026-03-29 02:30", epoch(2026, 3, 29, 1, 30)),
    ("waw", "2026-10-25 02:30", epoch(2026, 10, 25, 0, 30)),
    ("nul", "2026-02-10 10:00", epoch(2026, 2, 10, 10)),
    ("missing", "2026-02-10 10:00", epoch(2026, 2, 10, 10)),
    ("waw", "2024-02-29", epoch(2024, 2, 28, 23)),
    ("waw", "2026-02-29", None), ("waw", "32.13.2026, 10:00", None), (
        "waw",
        "0000-00-00 00:00:00",
        None
    ), ("waw", "brak daty", None), ("waw", "-", None), ("waw", "", None), ("waw", None, None), ("waw", "x" * 5000, None), ("nyc", "02/10/2026 13:00 PM", None),
]


def test_every_form(spark):
    rows = [(str(k), s, text, None) for k, (s, text, _) in enumerate(CASES)]
    out = {r["article_id"]: r["epoch_s"] for r in found_instants(spark.createDataFrame(rows + rows[:3], ARTICLES), spark.createDataFrame(ZONES, SOURCES)).collect()}
    for k, (_, text, want) in enumerate(CASES):
        assert out.get(str(k)) == want, text


def test_empty_and_null_ids(spark):
    src = spark.createDataFrame(ZONES, SOURCES)
    assert found_instants(spark.createDataFrame([], ARTICLES), src).count() == 0
    assert found_instants(spark.createDataFrame([(None, "waw", "2026-02-10", None)], ARTICLES), src).count() == 0


@pytest.mark.parametrize("field", ["published_at", "updated_at"])
def test_fields(spark, field):
    row = ("a", "waw", "2026-02-10T00:00:00Z" if field == "published_at" else None, "2026-02-10T00:00:00Z" if field == "updated_at" else None)
    out = found_instants(spark.createDataFrame([row], ARTICLES), spark.createDataFrame(ZONES, SOURCES)).collect()
    assert [(r["article_id"], r["field"], r["epoch_s"]) for r in out] == [("a", field, epoch(2026, 2, 10))]
