from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SMALL
from tokenizers import Tokenizer

from sylva.llm.packing import best_fit_decreasing, close_gaps, pack
from sylva.llm.tokens import encoder


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_and_gaps(seed):
    r = random.Random(seed)
    capacity = r.choice([8, 16, 1024])
    pieces = [(i, 5, r.randint(1, capacity - 1)) for i in range(r.randint(0, 200))]
    windows = best_fit_decreasing(pieces, capacity)
    rooms: list[int] = []
    for p in sorted(pieces, key=lambda p: -p[2]):  # plainly: the least room that fits
        fits = [x for x in rooms if x >= p[2]]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - p[2])
    assert sorted(capacity - sum(p[2] for p in w) for w in windows) == sorted(rooms)
    found: dict = {}
    for w in close_gaps(windows, capacity):
        used = sum(p[2] for p in w)
        assert used == capacity or used & (used - 1) == 0
        for d, s, n in w:
            found.setdefault(d, []).append((s, n))
    for d, _, n in pieces:
        at = 5
        for s, m in sorted(found[d]):
            assert s == at
            at += m
        assert at == 5 + n


def check(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_seq: dict = {}
    by_doc: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_edges(documents):
    assert pack(documents([])).count() == 0
    texts = {1: None, 2: "", 3: "x" * 50_000, 4: "<|endoftext|> é 😀 \x00", 5: "a b " * 1023}
    check(pack(documents([(k, v, None, None) for k, v in texts.items()], extra=True)).collect(), texts)
    twice = pack(documents([(1, "a b c", None, None)] * 3), with_ids=True).collect()
    assert sum(len(r.ids) // 4 for r in twice) == 3 * (len(encoder().encode_ordinary("a b c")) + 1)
    ordinary = pack(documents([(1, "<|endoftext|>", None, None)]), added=None, with_ids=True).collect()
    assert sum(r.length for r in ordinary) == 8 and all(r.doc_tokens == 8 for r in ordinary)


def test_ids_of_random_strings(documents):
    r = random.Random(5)
    pieces = ["<|endoftext|>", "<|endo", "ftext|>", " ", "  ", "\n", "\u00a0", "don't", "é", "e\u0301", "中", "😀", "\u200d", "123456", "\x00", "word", "A", "_", "...", "ß", "\u2028"]
    texts = {i: "".join(r.choice(pieces) for _ in range(r.randrange(40))) for i in range(3000)}
    check(pack(documents([(k, v, None, None) for k, v in texts.items()])).collect(), texts)


def test_added_tokens_are_those_of_the_named_file(spark, documents, tmp_path):
    from sylva.llm.queries import op10_pack

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext|>\n\n y", "<|endoftext|", "é <|endoftext|>😀 <|ENDOFTEXT|>", ""]
    documents([(i, x, None, None) for i, x in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in op10_pack(spark, str(tmp_path)).collect() if r.start == 0 and r.length == r.doc_tokens}
    want = {i: np.array([*plain.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(texts)}
    assert got and all(got[i] == (len(want[i]), zlib.crc32(want[i].tobytes())) for i in got)
    assert {0, 1} & set(got)
