from __future__ import annotations

import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from helpers import SMALL
from tokenizers import Tokenizer

from sylva.llm.common import new_folder
from sylva.llm.queries import op1_token_counts
from sylva.llm.rollup import VERSIONS, TokenRollup, revised, signed, token_counts


def totals(r):
    return {(x.source, x.lang, x.version): (x.documents, x.tokens) for x in r.totals().collect()}


def counts(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, old long, new long")


def test_batches_count_once(spark):
    r = TokenRollup(spark, new_folder(spark, "t"))
    assert totals(r) == {}
    docs = counts(spark, [("a", "en", 5, 7), ("a", "en", 3, 4), ("b", None, 2, 2), (None, "de", 0, 0)])
    assert r.apply("load", signed(docs, "v1", "old", 1)) and not r.apply("load", signed(docs, "v1", "old", 1))
    base = {("a", "en", "v1"): (2, 8), ("b", None, "v1"): (1, 2), (None, "de", "v1"): (1, 0)}
    assert totals(r) == base
    english = docs.filter("lang = 'en'")
    assert r.apply("recount", revised(english, ("v1", "old"), ("v2", "new")))
    after = base | {("a", "en", "v2"): (2, 11)}
    del after[("a", "en", "v1")]
    assert totals(r) == after
    r.compact()
    assert totals(r) == after and not r.apply("recount", english.limit(0).selectExpr("source", "lang", "'v' version", "1L documents", "1L tokens"))
    assert r.apply("delete", signed(docs.filter("source = 'b'"), "v1", "old", -1))
    del after[("b", None, "v1")]
    assert totals(r) == after
    r.compact()
    r.compact()
    assert totals(TokenRollup(spark, r.folder)) == after and r.committed("load") and not r.committed("other")


def test_a_failed_batch_counts_for_nothing(spark):
    r = TokenRollup(spark, new_folder(spark, "t"))
    bad = counts(spark, [("a", "en", 1, 1)]).selectExpr("source", "lang", "'v' version", "1L documents", "cast(raise_error('no') as long) tokens")
    with pytest.raises(Exception):
        r.apply("x", bad)
    assert totals(r) == {} and not r.committed("x")
    assert r.apply("x", signed(counts(spark, [("a", "en", 1, 1)]), "v", "old", 1)) and totals(r) == {("a", "en", "v"): (1, 1)}
    for name in ("", "a/b", "_x", "*"):
        with pytest.raises(ValueError):
            r.apply(name, bad)


def test_deletes_may_come_first(spark):
    r = TokenRollup(spark, new_folder(spark, "t"))
    docs = counts(spark, [("a", "en", 4, 4)])
    r.apply("d", signed(docs, "v", "old", -1))
    assert totals(r) == {("a", "en", "v"): (-1, -4)}
    r.apply("i", signed(docs, "v", "old", 1))
    assert totals(r) == {}


def plain_counts():
    """By the two versions: the tokenizer file of the first, and an encoding of the second's ranks."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    second = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: (len(first.encode(t or "", add_special_tokens=False).ids), len(second.encode_ordinary(t or "")))


def test_query_against_plain_counts(spark):
    count, want = plain_counts(), Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        one, many = count(r.text)
        if one >= 40:
            version, n = (list(VERSIONS)[0], one) if r.lang == "en" else (list(VERSIONS)[1], many)
            want[r.source, r.lang, version, "documents"] += 1
            want[r.source, r.lang, version, "tokens"] += n
    got = Counter()
    for r in op1_token_counts(spark, SMALL).collect():
        got[r.source, r.lang, r.version, "documents"], got[r.source, r.lang, r.version, "tokens"] = r.documents, r.tokens
    assert got == want


def test_counts_of_odd_texts(spark, documents):
    rows = [(1, "hello world", "en", "s"), (1, "hello world", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "word " * 100_000 + "x" * 50_000, "de", None), (5, "<|endoftext|> ñ 中", "zh", "s")]
    df = documents(rows, extra=True)
    count = plain_counts()
    got = sorted((tuple(r) for r in token_counts(df, keep=("doc_id", "size")).collect()))
    assert got == sorted((d, 7, *count(t)) for d, t, *_ in rows)
    r = TokenRollup(spark, new_folder(spark, "t"))
    assert r.apply("rows", signed(token_counts(df), "byte_bpe_50k", "byte_bpe_50k", 1))
    assert totals(r)[None, None, "byte_bpe_50k"] == (1, 0) and totals(r)["s", "en", "byte_bpe_50k"] == (3, 4)


def test_empty_batches_and_tables(spark, documents):
    r = TokenRollup(spark, new_folder(spark, "t"))
    none = token_counts(documents([]))
    assert r.apply("none", signed(none, "v", "byte_bpe_50k", 1)) and not r.apply("none", signed(none, "v", "byte_bpe_50k", 1))
    assert totals(r) == {}
    r.compact()
    assert totals(r) == {} and r.committed("none")
