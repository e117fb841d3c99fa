"""Personal data: direct identifiers by form, and terms that give them away by co-occurrence."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import Stages, join_each
from sylva.llm.spans import SPANS, Span, cut_out, with_spans

# The forms of the contract, with guards that keep each scan linear in the text.
BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_MOST = (16, 19), (8, 15), 255

#: Words that can be terms: letters alone, in any script.
TERM = re.compile(r"[^\W\d_]{4,40}")
KINDS = (*BASE_KINDS, "term")
#: Terms, pairs of a term and an entity, and repeated texts that are sent to every executor at most, 20 MB or so; more are joined.
BROADCAST_ROWS = 200_000
#: Terms whose sums a task holds before it passes them on.
HELD_TERMS = 1 << 18


def emails(text: str) -> list[Span]:
    """The matches of ``local@label(.label)+``: the local part reaches left as far as it can."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, done := domain.end()))
        at = text.find("@", at + 1 if at + 1 > done else done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _ip_part(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= IP_MOST


def base_spans(text: str) -> list[Span]:
    """Matches by kind as listed, then start; those that fail their test are dropped and not tried again."""
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_ip_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0] and CARD_DIGITS[0] <= len(digits := NOT_DIGIT.sub("", m[0])) <= CARD_DIGITS[1] and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(NOT_DIGIT.sub("", m[0])) <= PHONE_DIGITS[1]]
    return out


def _entity(kind: str, value: str) -> str:
    value = value.lower() if kind == "email" else value if kind == "ip" else NOT_DIGIT.sub("", value)
    return f"{kind}:{value}"


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def terms_of(text: str) -> set[str]:
    """The distinct terms of a whole text, in lower case. All counts and searches of terms are by this rule."""
    return set(map(str.lower, TERM.findall(text)))


def nearby(text: str, spans: list[Span], window: int) -> Iterator[tuple[int, str]]:
    """(entity, term) for each of the ``window`` terms before and after a span, however far apart they lie."""
    places = [m.span() for m in TERM.finditer(text)]
    starts, ends = [s for s, _ in places], [e for _, e in places]
    for kind, start, end in spans:
        entity = _hash(_entity(kind, text[start:end]))
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        for s, e in (*places[max(0, left - window) : left], *places[right : right + window]):
            yield entity, text[s:e].lower()


def _text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def scanned(docs: DataFrame, keep: Sequence[str] = (), window: int = 8) -> DataFrame:
    """Per document: the ``keep`` columns in ``kept``, text_hash, row, spans (by form) and, where there are any, entities, the terms near each and all terms."""
    near = T.ArrayType(T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.StringType())]))
    schema = T.StructType([T.StructField("kept", T.StructType([docs.schema[c] for c in keep] or [T.StructField("none", T.IntegerType())])), T.StructField("text_hash", T.LongType()), T.StructField("row", T.LongType()), T.StructField("spans", SPANS), T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("near", near), T.StructField("terms", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(2):
                text = t.as_py() or ""
                if spans := base_spans(text):
                    pairs = [{"entity": e, "term": w} for e, w in set(nearby(text, spans, window))]
                    found = ([{"kind": k, "start": s, "end": e} for k, s, e in spans], list({_hash(_entity(k, text[s:e])) for k, s, e in spans}), pairs, list(terms_of(text)))
                else:
                    found = ([], None, None, None)
                for c, v in zip(out, found):
                    c.append(v)
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            columns = [batch.column(0).cast(arrow.field(0).type), batch.column(1), rows, *(pa.array(c, arrow.field(3 + i).type) for i, c in enumerate(out))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    kept = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(kept.alias("kept"), _text_hash(), "text").mapInArrow(run, schema)


def _term_counts(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """term, n_docs: how many distinct texts hold it. ``texts`` has text and copies: each row counts as one of so many."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)
    arrow = pa.schema([("term", pa.string()), ("part", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value
        sums: defaultdict[str, float] = defaultdict(float)
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist()):
                words = terms_of(t.as_py() or "")
                for word in words if only is None else words & only:
                    sums[word] += 1 / n
            if len(sums) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], schema=arrow)
                sums.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], schema=arrow)

    return texts.select("text", "copies").mapInArrow(run, "term string, part double").groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_docs"))


def _pair_counts(rows: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """entity, term, n_both: how many distinct texts hold both, near or not. ``rows`` has row, entities, terms and copies."""
    n_both = F.round(F.sum(1 / F.col("copies"))).cast("long").alias("n_both")
    if pairs.count() <= most:
        by_entity = F.broadcast(pairs.groupBy("entity").agg(F.collect_list("term").alias("tried")))
        held = rows.select("terms", "copies", F.explode("entities").alias("entity")).join(by_entity, "entity")
        held = held.select("entity", "copies", F.explode(F.array_intersect("terms", "tried")).alias("term"))
    else:
        held = rows.select("row", "copies", F.explode("terms").alias("term")).join(pairs.select("entity", "term"), "term")
        held = held.join(rows.select("row", F.explode("entities").alias("entity")), ["row", "entity"], "left_semi")
    return held.groupBy("entity", "term").agg(n_both)


def disclosing_terms(docs: DataFrame, window: int = 8, least_share: float = 0.9, least_bits: float = 4.0, broadcast_rows: int = BROADCAST_ROWS, found: DataFrame | None = None) -> DataFrame:
    """Terms that reveal a protected entity: term, entity, n_both, n_docs, share, bits.

    A term is tried with each entity that it is among the ``window`` terms before or after in at least two distinct texts.
    All counts are of distinct texts: a document counts as one of so many copies, so that sums over tasks are small and
    exact. ``n_docs`` hold the term and ``n_both`` of them the entity, near or not. ``share`` estimates
    P(entity | term) from the texts but one, (n_both - 1) / (n_docs - 1), so that a text is no evidence for itself.
    ``bits`` is the pointwise mutual information log2 P(entity | term) / P(entity), with one text added for P(entity).
    """
    stages = Stages(docs.sparkSession, "pii")
    found = found if found is not None else stages.write(scanned(docs, (), window), "scanned")
    repeated = found.groupBy("text_hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("copies", F.col("n"))
    repeated = stages.write(repeated, "repeated")
    few = repeated.count() <= broadcast_rows

    def with_copies(rows: DataFrame, by: str) -> DataFrame:
        one = F.coalesce("copies", F.lit(1)).alias("copies")
        joined = rows.join(F.broadcast(repeated.drop("n")), "text_hash", "left") if few else join_each(rows, repeated, "text_hash", by, stages, "left")
        return joined.select(*[c for c in rows.columns if c != "text_hash"], one)

    rows = stages.write(with_copies(found.filter("entities is not null").select("row", "text_hash", "entities", "terms"), "row"), "rows")
    entities = rows.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("n_entity"))
    near = found.filter("near is not null").select("text_hash", F.explode("near").alias("p")).select("p.entity", "p.term", "text_hash").distinct()
    pairs = near.groupBy("entity", "term").count().filter("count > 1").select("entity", "term").join(entities, "entity")
    pairs = stages.write(pairs, "pairs")
    wanted = [r.term for r in pairs.select("term").distinct().limit(broadcast_rows + 1).collect()]
    # The same counts come of all terms; with few wanted, others aren't counted.
    texts = with_copies(docs.select("text", _text_hash().alias("text_hash"), F.monotonically_increasing_id().alias("_at")), "_at")
    counts = _term_counts(texts, frozenset(wanted) if len(wanted) <= broadcast_rows else None)
    # A term in more texts than these misses the share, were they all the entity's.
    most = F.floor((F.col("n_entity") - 1) / F.lit(least_share)) + 2
    pairs = stages.write(pairs.join(counts, "term").filter(F.col("n_docs").between(2, most)), "tried")
    both = pairs.join(_pair_counts(rows, pairs, broadcast_rows), ["entity", "term"])
    total = docs.count() - (repeated.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    share = (F.col("n_both") - 1) / (F.col("n_docs") - 1)
    bits = F.log2(F.col("share") / ((F.col("n_entity") + 1) / F.lit(total + 1)))
    out = both.withColumn("share", share).withColumn("bits", bits).filter((F.col("share") >= least_share) & (F.col("bits") >= least_bits))
    out = stages.write(out.select("term", "entity", "n_both", "n_docs", "share", "bits"), "terms")
    stages.drop("scanned", "repeated", "rows", "pairs", "tried", "hot")
    return out


def spans_with(text: str, wanted: frozenset[str] | set[str]) -> list[Span]:
    """Spans by form, and those of the wanted terms outside them, by start."""
    base = base_spans(text)
    if not wanted:
        return base
    # The union of the base spans, as sorted bounds: a term is outside if both its ends fall into one gap.
    bounds = [0]
    for s, e in sorted((s, e) for _, s, e in base):
        if len(bounds) > 1 and s <= bounds[-1]:
            bounds[-1] = max(bounds[-1], e)
        else:
            bounds += [s, e]
    more = []
    for m in TERM.finditer(text):
        if m[0].lower() in wanted:
            at = bisect_right(bounds, m.start()) - 1
            if at % 2 == 0 and (at + 1 == len(bounds) or m.end() <= bounds[at + 1]):
                more.append(("term", *m.span()))
    return base + more


def _with_terms(docs: DataFrame, terms: DataFrame, stages: Stages) -> DataFrame:
    """The documents with ``_terms``, those of ``terms`` that each text holds, for more terms than are broadcast.

    They depend on the text alone and are found by its digest, copies together."""
    arrow = pa.schema([("_digest", pa.binary()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for w in terms_of(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(2)], schema=arrow)

    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    held = docs.select(digest.alias("_digest"), "text").mapInArrow(run, "_digest binary, term string").join(terms, "term")
    held = held.groupBy("_digest", "term").count().groupBy("_digest").agg(F.collect_list("term").alias("_terms"), F.max("count").alias("n"))
    rows = docs.withColumns({"_digest": digest, "_at": F.monotonically_increasing_id()})
    return join_each(rows, stages.write(held, "held"), "_digest", "_at", stages, "left").drop("_digest", "_at")


def personal_spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",), broadcast_rows: int = BROADCAST_ROWS, **thresholds) -> DataFrame:
    """The ``keep`` columns and the personal data of each whole text as ``spans``, by kind and start.

    Kinds: ``email``, ``ip``, ``card``, ``phone`` by form, and ``term`` for words that disclose one of
    them (:func:`disclosing_terms`), outside those. Null and empty texts have no spans; every row
    stays. Up to ``broadcast_rows`` terms are sent to the executors; more are joined by text, with the same result.
    """
    stages = Stages(docs.sparkSession, "pii")
    found = stages.write(scanned(docs, keep, thresholds.get("window", 8)), "scanned")
    terms = disclosing_terms(docs, broadcast_rows=broadcast_rows, found=found, **thresholds).select("term").distinct()
    few = frozenset(r.term for r in terms.limit(broadcast_rows + 1).collect())
    if not few:
        return found.select("kept.*", "spans") if keep else found.select("spans")
    if len(few) > broadcast_rows:
        return with_spans(_with_terms(docs, terms, stages), lambda text, terms: spans_with(text, set(terms or ())), keep, "_terms")
    sent = docs.sparkSession.sparkContext.broadcast(few)
    return with_spans(docs, lambda text: spans_with(text, sent.value), keep)


def sanitised(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **thresholds) -> DataFrame:
    """The documents with identifiers generalised to their kind and disclosing terms removed; n_chars follows."""
    terms = disclosing_terms(docs, broadcast_rows=broadcast_rows, **thresholds).select("term").distinct()
    few = frozenset(r.term for r in terms.limit(broadcast_rows + 1).collect())
    replace = lambda kind, value: "" if kind == "term" else f"[{kind.upper()}]"
    if len(few) > broadcast_rows:
        rows = _with_terms(docs, terms, Stages(docs.sparkSession, "pii"))
        return cut_out(rows, lambda text, terms: spans_with(text, set(terms or ())), replace, "_terms").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(few)
    return cut_out(docs, lambda text: spans_with(text, sent.value), replace)
