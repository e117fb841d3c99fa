"""Secret scans: known forms, and random strings that a tokenizer finds hard to compress."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame

from sylva.llm.spans import Span, cut_out, with_spans
from sylva.llm.tokens import BYTE_BPE, encoder

# The forms of the contract.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Strings that may be random: long, of the letters of Base64 and its URL form.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: Characters of a random string at least, and the parts of a run between marks, from coarse to fine.
LEAST = 20
LEVELS = tuple(map(re.compile, (r"[^/=]+", r"[^/=.]+", r"[^/=._]+", r"[^/=._-]+")))
#: Digests and identifiers that look random and are no secrets, as whole strings.
KNOWN = (
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})",  # digests, lower case
    r"(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})",  # digests, upper case
    r"sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}",  # subresource integrity
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9+/_=.-]+",  # numbers, dates, rules
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_][0-9]{2}[0-9.+-]*Z?",  # points in time
)


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind; those that fail its test are dropped."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def secret_finder(max_chars_per_token: float = 1.9, known: Sequence[str] = KNOWN, ranks: str = BYTE_BPE) -> Callable[[str], list[Span]]:
    """A function from a text to its secrets, by start and then kind: ``assign``, ``access``, ``hex``, ``random``.

    ``random`` are strings of 20 and more characters of which a token covers few: text that the
    vocabulary was made from has about four characters a token, invented words over two, random
    strings under 1.9. A run that passes as a whole is tried again between its marks, and a part without marks
    by every stretch of 20 characters in it. Known digests and identifiers are left out, and so is
    the part of a run that a span of another kind covers.
    """
    passed = re.compile("|".join(f"(?:{p})" for p in known)) if known else None
    order = {k: i for i, k in enumerate((*BASE_KINDS, "random"))}

    def parts(value: str, start: int, levels: Sequence[re.Pattern] = LEVELS) -> Iterator[tuple[int, int]]:
        if len(value) < LEAST or passed and passed.fullmatch(value):
            return
        tokens = encoder(ranks).encode_ordinary(value)
        if len(value) < max_chars_per_token * len(tokens):
            yield start, start + len(value)
        elif levels:
            for m in levels[0].finditer(value):
                yield from parts(m[0], start + m.start(), levels[1:])
        else:
            yield from stretches(tokens, start)

    def stretches(tokens: list[int], start: int) -> Iterator[tuple[int, int]]:
        """Unions of the stretches of tokens that are random, each as short as ``LEAST`` allows."""
        at = [start]  # the characters are all ASCII
        for token in tokens:
            at.append(at[-1] + len(encoder(ranks).decode_single_token_bytes(token)))
        j, found = 0, None
        for i in range(len(tokens)):
            while j < len(tokens) and at[j] - at[i] < LEAST:
                j += 1
            if at[j] - at[i] < LEAST:
                break
            if at[j] - at[i] < max_chars_per_token * (j - i):
                if found and at[i] <= found[1]:
                    found = found[0], at[j]
                else:
                    if found:
                        yield found
                    found = at[i], at[j]
        if found:
            yield found

    def find(text: str) -> list[Span]:
        base = base_spans(text)
        out = list(base)
        covered, c = sorted((s, e) for _, s, e in base), 0
        for m in CANDIDATE.finditer(text):
            at, end = m.span()
            while at < end:
                while c < len(covered) and covered[c][1] <= at:
                    c += 1
                s, e = covered[c] if c < len(covered) and covered[c][0] < end else (end, end)
                if s > at:
                    out += [("random", *x) for x in parts(text[at:s], at)]
                at = e
        return sorted(out, key=lambda x: (x[1], order[x[0]]))

    return find


def secret_spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The ``keep`` columns and the secrets of each whole text as ``spans`` (kind, start, end in code points).

    One pass without a shuffle. Null and empty texts have no spans; every row stays, repeated ones too.
    """
    return with_spans(docs, secret_finder(**options), keep)


def without_secrets(docs: DataFrame, **options) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; n_chars follows."""
    return cut_out(docs, secret_finder(**options), lambda kind, value: f"[{kind.upper()}]")
