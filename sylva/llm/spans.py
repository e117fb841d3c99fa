"""Spans of texts: finding them in batches, their text form, and cutting them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Kind, start and end in code points, end exclusive.
Span = tuple[str, int, int]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def with_spans(docs: DataFrame, find: Callable[..., list[Span]], keep: Sequence[str] = ("doc_id",), terms: str | None = None) -> DataFrame:
    """The ``keep`` columns of all rows and ``spans``, which ``find`` makes of each whole text (null: empty), and of the row's ``terms`` if there are such."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", SPANS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.columns[len(keep) :]
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py() or "", *(x.as_py() for x in more))] for t, *more in zip(*given)]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))] + [pa.array(found, arrow.field(len(keep)).type)], schema=arrow)

    # The text goes last and under a name of its own, as it may be one of the kept columns.
    return docs.select(*keep, F.col("text").alias("_text"), *([F.col(terms).alias("_terms")] if terms else [])).mapInArrow(run, schema)


def cut_out(docs: DataFrame, find: Callable[..., list[Span]], replace: Callable[[str, str], str], terms: str | None = None) -> DataFrame:
    """The documents, without ``terms``, with every span replaced by ``replace(kind, value)``; overlapping spans become one, of the first's kind.

    n_chars, where there is one, follows the text. Null texts stay null.
    """
    names = [c for c in docs.columns if c != terms]
    schema = T.StructType([docs.schema[c] for c in names])
    at = names.index("text")
    arrow = to_arrow_schema(schema)

    def clean(text: str | None, *more) -> str | None:
        if not text or not (spans := find(text, *more)):
            return text
        out, done, kind, start = [], 0, "", -1
        for k, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
            if start >= 0 and s < done:
                done = max(done, e)
                continue
            if start >= 0:
                out.append(replace(kind, text[start:done]))
            out.append(text[done:s])
            kind, start, done = k, s, e
        out += [replace(kind, text[start:done]), text[done:]]
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            given = zip(columns[at], *batch.columns[len(names) :])
            columns[at] = pa.array([clean(*(x.as_py() for x in row)) for row in given], arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = docs.select(*names, *([terms] if terms else [])).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order they are in."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda x: x.kind.isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")
