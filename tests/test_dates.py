from datetime import date

import pytest

from sluice.functions import dates as D

R = D.DateReader(D.DateProfile(2026))
PLAIN = D.DateReader(D.DateProfile(2026).plain())


@pytest.mark.parametrize(
    "text, want",
    [
        ("Fiscal Year Ended June 30, 2025\nAdopted on August 4, 2025", date(2025, 8, 4)),
        ("Effective January 1, 2026. Signed March 3, 2026", date(2026, 3, 3)),
        ("Offers due by May 1, 2026\nPosted April 2, 2026", date(2026, 4, 2)),
        ("The next regular meeting on June 15, 2026.\nMinutes of May 20, 2026", date(2026, 5, 20)),
        ("The session was held on May 20, 2026", date(2026, 5, 20)),
        ("will be held May 21, 2026", None),
        ("Wednesday, May 20th\nRoom 4, 2025", date(2025, 5, 20)),
        ("Wednesday, May 20th", date(2026, 5, 20)),
        ("May 12 only", None),
        ("Report May 2024", date(2024, 5, 1)),
        ("on 2026-05-20T00:00", None),
        ("on 2026-05-20 here", date(2026, 5, 20)),
        ("5/6/25", date(2025, 5, 6)),
        ("13/6/2025", None),
        ("April 31, 2025 and April 30, 2025", date(2025, 4, 30)),
        ("January 1, 1999", None),
        ("DATE: 2025-02-03\nMay 4, 2025", date(2025, 2, 3)),
        ("DATE: 1999-02-03\nMay 4, 2025", date(2025, 5, 4)),
        ("", None),
        (None, None),
    ],
)
def test_text(text, want):
    assert R.read(text) == want


def test_plain_takes_first():
    assert PLAIN.read("Fiscal year ended June 30, 2025, adopted August 4, 2025") == date(2025, 6, 30)


def test_head_only():
    assert R.read("x" * 3500 + " May 4, 2025") is None


def test_columns(spark):
    rows = [("https://a.example/2026-03-16 REGULAR.pdf",), ("docs/03/16/2026/a.pdf",), ("January-13-2026-School.pdf",), ("2031-01-01 then 2025-01-02",), ("none",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    got = [r[0] for r in df.select(D.date_from_url("u", D.DateProfile(2026))).collect()]
    assert got == [date(2026, 3, 16), date(2026, 3, 16), date(2026, 1, 13), date(2025, 1, 2), None, None]
    iso = spark.createDataFrame([("2026-03-12T10:00",), ("2026-13-01",), ("",), (None,), ("x2026-01-01",)], "v string")
    assert [r[0] for r in iso.select(D.date_from_iso_prefix("v")).collect()] == [date(2026, 3, 12), None, None, None, None]
    text = spark.createDataFrame([("Minutes of May 20, 2026",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(D.date_from_text("t", D.DateProfile(2026))).collect()] == [date(2026, 5, 20), None, None]
