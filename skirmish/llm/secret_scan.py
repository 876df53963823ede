"""Operator 13: secrets by base patterns and by token efficiency.

Base spans (``KINDS``) follow the given patterns and stay as they are. The method adds spans of kind
``random``: a run of ``LEAST`` or more of the characters that keys and tokens are made of, which the byte-pair vocabulary
spells with few characters a token (``RATIO`` at most). Words and names are frequent, so a vocabulary holds
long pieces of them; random strings fall into pieces of one or two characters.

Left out before the test are known digests and identifiers: strings of digits, UUIDs, digests by their length in hex
or as labelled base64, parts of mail addresses and of the path of an address, points in time, names built of words and
numbers (four characters a part at least) or with a quarter of separators, and words in one case under ``LONG_WORD`` characters (rare languages have words as inefficient as random letters).
``known`` adds a table of published values, which are left out by an anti-join on the value.

Every text is read once and whole, long runs are encoded in pieces of ``PIECE`` characters, so the work is linear. The
vocabulary file is read on the driver (its size is checked against ``VOCABULARY``) and goes to the tasks with the code. A null
text is empty; rows that repeat a doc_id are reported row by row; a null doc_id stays; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

KINDS = ("assign", "access", "hex")
ADDED = "random"
TOKENS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of the largest vocabulary file that is sent to the tasks.
VOCABULARY = 16 << 20
LEAST = 16
RATIO = 2.0
LONG_WORD = 40
PIECE = 512

# The contract's patterns; possessive where that changes no match, so that long runs cost linear time.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
#: A whole run, of ASCII characters on both sides: parts of words with other letters are no candidates.
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=\x80-\U0010ffff-])[A-Za-z0-9+/_=-]{{{LEAST},}}+(?![\x80-\U0010ffff])")

# How the vocabulary's own tokenizer splits a text, digest lengths in hex, labels of base64 digests.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
LABELS = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)[-_=]", re.I | re.A)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]+")
NUMBERS = re.compile(r"[0-9+/_=-]+")
ONE_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words (also capitalised or in capitals) of three letters and more, and numbers, between separators.
NAME = re.compile(r"[+/_=-]*+(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}|[0-9]++)(?:[+/_=-]++|(?=[A-Z0-9])|(?<=[0-9])|\Z))+")
TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9-]+Z?")
PARTS = re.compile(r"[A-Za-z]+|[0-9]+")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D\"'<>]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """A digest, a number, a word or a name by its form alone."""
    if NUMBERS.fullmatch(run) or UUID.fullmatch(run) or LABELS.match(run) or TIME.fullmatch(run):
        return True
    if ANY_HEX.fullmatch(run) and len(run) in DIGESTS:
        return True
    if ONE_CASE.fullmatch(run):
        return len(run) < LONG_WORD
    parts = PARTS.findall(run)
    letters = sum(map(len, parts))
    return 4 * letters < 3 * len(run) or (bool(NAME.fullmatch(run)) and 4 * len(parts) <= letters)


def tokenizer(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


_tokenizers: dict[bytes, tiktoken.Encoding] = {}


def _tokenizer(ranks: bytes) -> tiktoken.Encoding:
    """One for each Python worker, as it takes longer to build than many texts to read."""
    key = hashlib.sha256(ranks).digest()
    if key not in _tokenizers:
        _tokenizers[key] = tokenizer(ranks)
    return _tokenizers[key]


def efficiency(tokens: tiktoken.Encoding, run: str) -> float:
    """Characters a token."""
    return len(run) / sum(len(tokens.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def random_spans(text: str, base: list[tuple[int, int, int]], tokens: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, float]]:
    """(start, end, characters a token) of the runs that pass the test, clear of the base spans."""
    out: list[tuple[int, int, float]] = []
    addresses: list[tuple[int, int]] | None = None
    ahead = at = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in "-_/":  # closing marks, not padding
            b -= 1
        eq = text.rfind("=", a, b - 2)  # key=value is told by its value
        a = eq + 1 if eq >= 0 and b - eq > LEAST else a
        run = text[a:b]
        if b - a < LEAST or is_known(run) or text[a - 1 : a] == "@" or text[b : b + 1] == "@":
            continue
        while ahead < len(base) and base[ahead][0] < b and base[ahead][2] <= a:
            ahead += 1
        if any(x < b and a < y for x, _, y in base[ahead : ahead + 3 * len(KINDS)]):
            continue
        if addresses is None:
            addresses = [x.span() for x in ADDRESS.finditer(text)] if "://" in text else []
        while at < len(addresses) and addresses[at][1] <= a:
            at += 1
        if at < len(addresses) and addresses[at][0] <= a and text[a - 1 : a] != "=":
            continue
        found = efficiency(tokens, run)
        if found <= ratio:
            out.append((a, b, found))
    return out


SPAN = "array<struct<start:int,kind:int,stop:int,value:string,ratio:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("ratio", pa.float64())]))


def _scan(ranks: bytes, ratio: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(ranks)
        for batch in batches:
            found = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                spans = [{"start": a, "kind": k, "stop": b, "value": None, "ratio": None} for a, k, b in base]
                spans += [{"start": a, "kind": len(KINDS), "stop": b, "value": text[a:b], "ratio": r} for a, b, r in random_spans(text, base, tokens, ratio)]
                found.append(sorted(spans, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(found, _SPAN)], ["row", "doc_id", "spans"])

    return run


def find(docs: DataFrame, known: DataFrame | None = None, tokens: str = TOKENS, ratio: float = RATIO) -> DataFrame:
    """Per row: doc_id and its spans (start, kind, stop, the value and characters a token of added ones).

    ``known`` has a column ``value`` of strings that are public and so no secrets.
    """
    path = Path(tokens)
    if path.stat().st_size > VOCABULARY:
        raise ValueError(f"{tokens} has over {VOCABULARY} bytes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = rows.mapInArrow(_scan(path.read_bytes(), ratio), f"row long, doc_id long, spans {SPAN}")
    if known is None:
        return spans.select("doc_id", "spans")
    spans = cut(spans, "secrets")
    public = known.select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL").distinct()
    met = spans.select("row", F.explode("spans.value").alias("value")).where("value IS NOT NULL").join(public, "value", "left_semi")
    met = met.groupBy("row").agg(F.collect_set("value").alias("met"))
    out = spans.join(met, "row", "left")
    stay = F.filter("spans", lambda s: ~F.coalesce(F.array_contains("met", s["value"]), F.lit(False)))
    return out.select("doc_id", F.when(F.col("met").isNull(), F.col("spans")).otherwise(stay).alias("spans"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The query's columns."""
    out = find(docs, **options)
    name = F.array(*map(F.lit, (*KINDS, ADDED)))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["stop"])), ",")

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return out.select(
        "doc_id", *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        number(len(KINDS)).alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; all other columns stay. Overlapping spans are one."""
    tokens, ratio = Path(options.get("tokens", TOKENS)).read_bytes(), options.get("ratio", RATIO)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokens)
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text = x.as_py()
                base = base_spans(text or "")
                parts, done = [], 0
                for a, b in sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, _ in random_spans(text or "", base, own, ratio)]):
                    if a >= done:
                        parts += [text[done:a], mark]
                    done = max(done, b)
                out.append(None if text is None else "".join([*parts, text[done:]]))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def brute_base(text: str | None) -> tuple[list[int], str]:
    """The contract's patterns as they stand, for tests."""
    text, out = text or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    for m in re.finditer(rf"({key}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort()
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == i for _, k, _ in out) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest()
