"""Values in clauses, brought to one form."""

from pyspark.sql import functions as F

from clausegrid.operators import values as N

CASES = {
    "within 30 days, thirty (30) days or 30 calendar days": [("DURATION", "30 days")] * 3, "two weeks or 14 days; 1 day": [("DURATION", "14 days"), ("DURATION", "14 days"), ("DURATION", "1 day")],
    "12 months, one year, 18 Months, 1 month": [("DURATION", "1 year"), ("DURATION", "1 year"), ("DURATION", "18 months"), ("DURATION", "1 month")], "24 months and 2 years": [("DURATION", "2 years")] * 2,
    "USD 1,000.00 or $1000 or US$ 1 thousand or 1,000 dollars": [("AMOUNT", "USD 1000")] * 4, "AED 5.5 million; €20; 2 million euros; £1.50": [("AMOUNT", "AED 5500000"), ("AMOUNT", "EUR 20"), ("AMOUNT", "EUR 2000000"), ("AMOUNT", "GBP 1.5")],
    "5% or 5.00 per cent or 5 percent": [("PERCENT", "5%")] * 3, "2024-03-01, 1 March 2024, 1st of March, 2024, March 1, 2024": [("DATE", "2024-03-01")] * 4, "31 June 2024 and 2024-13-01": [],
    "courts of Dubai, the UAE and the United Arab Emirates; England and Wales; New York": [("JURISDICTION", "UAE")] * 3 + [("JURISDICTION", "UK"), ("JURISDICTION", "NY")],
    "100 USD in 10 days": [("DURATION", "10 days"), ("AMOUNT", "USD 100")], "nothing here, bone day, Ukraine": [], "": [], None: [], "0 days or 0 months": [("DURATION", "0 days"), ("DURATION", "0 months")], "USD 10 usd 10": [("AMOUNT", "USD 10")] * 2,
}


def test_variants_of_a_value_are_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r.i: [(v.kind, v.value) for v in r.v] for r in df.select("i", N.values_of(F.col("t")).alias("v")).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_rows_counts_and_ranges(spark):
    df = spark.createDataFrame([(1, "30 days, two weeks and 1 year"), (2, "USD 5; 30 days"), (3, None)], "i int, content string")
    rows = N.value_rows(df, ["i"])
    assert sorted((r.i, r["at"], r.kind, float(r.number), r.unit, r.source) for r in rows.collect()) == [
        (1, 0, "DURATION", 30, "days", "30 days"), (1, 1, "DURATION", 14, "days", "two weeks"), (1, 2, "DURATION", 12, "months", "1 year"), (2, 0, "DURATION", 30, "days", "30 days"), (2, 1, "AMOUNT", 5, "USD", "USD 5"),
    ]
    assert [(r.kind, r.n, r["values"]) for r in N.kind_counts(rows).collect()] == [("DURATION", 4, 3), ("AMOUNT", 1, 1)]
    assert {r.unit: (float(r.low), float(r.high), r.n) for r in N.in_one_unit(rows, "DURATION").collect()} == {"days": (14, 30, 3), "months": (12, 12, 1)}
