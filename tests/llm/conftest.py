from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside, as columns of the documents.
CLASHING = {"size": 7, "hash": 8, "node": 9, "row": 1, "key": 2, "spans": 3, "copies": 4, "_text": 5, "log_weight": 6, "taken": 1, "gone": 2}


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text, lang, source)."""
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCUMENTS)
        return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()]) if extra else df

    return make
