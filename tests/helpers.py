"""Small builders shared by the tests."""

import datetime as dt
from decimal import Decimal

from pyspark.sql.types import LongType, StructField, StructType

from jobspectra.schema import POSTING, RAW_POSTING

DAY = dt.datetime(2026, 5, 1)


def raw(spark, *rows):
    names = [*RAW_POSTING.names, "seq"]
    schema = StructType([*RAW_POSTING.fields, StructField("seq", LongType())])
    data = []
    for i, row in enumerate(rows):
        filled = {"title": "Frontend developer", "skills": [], "published_at": DAY, "source_type": "html", "seq": i, **row}
        for amount in ("salary_from", "salary_to"):
            if filled.get(amount) is not None:
                filled[amount] = Decimal(str(filled[amount]))
        data.append(tuple(filled.get(n) for n in names))
    return spark.createDataFrame(data, schema)


def facts(spark, *rows):
    data = []
    for i, row in enumerate(rows):
        filled = {"posting_id": i + 1, "title": "t", "skills": [], "published_at": DAY, **row}
        for amount in ("estimate", "from_net", "to_net"):
            if filled.get(amount) is not None:
                filled[amount] = Decimal(str(filled[amount]))
        data.append(tuple(filled.get(n) for n in POSTING.names))
    return spark.createDataFrame(data, POSTING)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
