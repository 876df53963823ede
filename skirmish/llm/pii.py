"""Operator 6: personal data by base patterns and bootstrapped contextual extraction.

Base spans (``KINDS``) follow the given patterns and stay as they are. They and keyed secrets
(``SEED_KEYS``, ``SEED_SHAPE``) are the seeds; a secret in one token with its key (pwd=ab1) may have any value.
Candidates are all whitespace tokens with a digit outside the base spans, of any length, and any token that stands
behind the key of a secret (password: hunter2): such a value is a seed if it has eight characters and a digit, and
left to its patterns otherwise. Two to ``RUN`` tokens of under eight characters that follow each other, with no
punctuation between, are one candidate (12 34 56 78); in longer runs every token is one of its own. Every seed and
candidate induces lexical patterns: the word before it (L), the two words before it (LL), the word behind it (R), and
its own key, the part up to the last "=" or ":" or its leading letters (K).

Spark scores the bipartite graph for ``ROUNDS`` rounds: a pattern's confidence is the confidence of its
instances over all occurrences of the pattern in the corpus (for L, LL and R, of the words anywhere), plus
``SMOOTH``. An occurrence's confidence is the noisy-or of its patterns; an instance's is 1 for seeds, and else that of its
occurrences on (geometric) average, so that a number which stands in many places is not sure because one of
them looks like an identifier's. Candidates whose confidence reaches ``SURE`` become spans of kind ``id``.

Word counts are filtered inside the scan while there are at most ``BOUND`` words to count, and by a join
otherwise. The graph holds seeds, candidates and their words, no other text; a pattern or an instance with a third
of all rows is an ordinary aggregation key. A null text is empty. Rows that repeat a doc_id are
reported row by row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from .words import STEP, Words, blocks, mix

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SMOOTH = 2.0
SURE = 0.5
#: Short tokens with digits that may be one identifier.
RUN = 6
#: Characters from which on a token with a digit stands for itself.
LONG = 8
#: Words beside seeds and candidates up to which the count of words is filtered inside the scan.
BOUND = 2_000_000

# Names of secrets, and a public shape of access keys.
SEED_KEYS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key")
KEYED = re.compile(rf"(?:{'|'.join(SEED_KEYS)})[=:](?=.)", re.I | re.S)
KEY_ALONE = re.compile(rf"[\"'(\[{{<]*(?:{'|'.join(SEED_KEYS)})[\"']?[=:]\Z", re.I)
ANY_KEY = re.compile(rf"(?:{'|'.join(SEED_KEYS)})[\"']?[\x20\x09-\x0D]*[=:]", re.I)
SEED_SHAPE = re.compile(r"AKIA[0-9A-Z]{12,}\Z")

# The contract's patterns; possessive, anchored at the start of a run, so that long runs cost linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one possible local part: the run before it, behind the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


#: The last two bits of a pattern tell its kind: two words before, a word before, a word behind, an own key.
TWO, BEFORE, BEHIND, KEY = 0, 1, 2, 3


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words with ASCII letters in lower case."""
    data = "\n".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True).hash


def _free(hashes: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers with the last two bits free."""
    return hashes.view(np.int64) & ~3


def _key(token: str) -> str:
    cut_at = max(token.rfind("="), token.rfind(":")) + 1
    return token[:cut_at] if cut_at else re.match(r"[^0-9]*", token)[0]


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, int, tuple[str, str, str, str]]]:
    """(start, end, instance, seed, base kind or -1, the two words before, word behind and key) of the seeds and candidates."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    ends = [b for _, b in tokens]
    keys = bool(ANY_KEY.search(text))
    out = []

    def word(i: int) -> str:
        return text[slice(*tokens[i])] if 0 <= i < len(tokens) else ""

    def add(a: int, b: int, instance: str, seed: bool, kind: int, key: str) -> None:
        i = bisect_right(ends, a)
        out.append((a, b, _hash(instance), seed, kind, (word(i - 2), word(i - 1), word(bisect_left(ends, b) + 1), key)))

    def close() -> None:
        parts = [text[a:b] for a, b in run]
        if 2 <= len(run) <= RUN:
            add(run[0][0], run[-1][1], " ".join(parts), False, -1, _key(parts[0]))
        else:
            for (a, b), part in zip(run, parts, strict=True):
                add(a, b, part, bool(SEED_SHAPE.match(part)), -1, _key(part))
        run.clear()

    for a, kind, b in base:
        add(a, b, text[a:b], True, kind, "")
    taken = 0
    run: list[tuple[int, int]] = []
    for i, (first, last) in enumerate(tokens):
        a, b = first, last
        while b - a and text[a] in "\"'([{<":
            a += 1
        while b - a and text[b - 1] in "\"')]}>.,;:!?#*$%&|":
            b -= 1
        token = text[a:b]
        digit = bool(DIGITS.search(token))
        glued = behind = False
        if keys and token:
            glued = bool(KEYED.match(token))
            if i >= 1 and not glued and token not in ("=", ":"):
                ahead = word(i - 1)
                behind = bool(KEY_ALONE.match(ahead)) or (ahead in ("=", ":") and i >= 2 and word(i - 2).lower() in SEED_KEYS)
        wanted = digit or glued or behind
        if wanted:
            while taken < len(base) and base[taken][2] <= a:
                taken += 1
            wanted = not any(x < b and a < y for x, _, y in base[taken : taken + 8])
        alone = not wanted or glued or behind or len(token) >= LONG
        if run and (alone or a > first):
            close()
        if not wanted:
            continue
        if alone:
            seed = glued or (behind and digit and len(token) >= LONG) or bool(SEED_SHAPE.match(token))
            add(a, b, token, seed, -1, _key(token))
        else:
            run.append((a, b))
            if b < last:
                close()
    close()
    return out


NODE = "array<struct<start:int,stop:int,instance:long,seed:boolean,kind:int,patterns:array<long>>>"
SCHEMA = f"row long, doc_id long, counts array<long>, base string, nodes {NODE}"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("kind", pa.int32()), ("patterns", pa.list_(pa.int64()))]))
    for batch in batches:
        counts, base, found = [], [], []
        for x in batch.column("text").to_pylist():
            text = x or ""
            spans = base_spans(text) if DIGITS.search(text) or "@" in text else []
            counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
            base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
            found.append(nodes(text, spans) if spans or DIGITS.search(text) or ANY_KEY.search(text) else [])
        around = sorted({w for own in found for n in own for w in n[5][:3] if w})
        hashes = word_hashes(around) if around else np.zeros(0, np.uint64)
        place = {w: i for i, w in enumerate(around)}
        known = dict(zip(around, _free(hashes).tolist(), strict=True))
        twos = sorted({n[5][:2] for own in found for n in own if n[5][0]})
        one, two = ([place[x[k]] for x in twos] for k in (0, 1))
        # as Words.grams(2)
        before_two = dict(zip(twos, _free(mix(hashes[one] + hashes[two] * STEP)).tolist(), strict=True)) if twos else {}
        keys = ("start", "stop", "instance", "seed", "kind", "patterns")

        def patterns(far: str, before: str, behind: str, key: str) -> list[int]:
            parts = (
                (far and before_two[far, before], TWO), (before and known[before], BEFORE),
                (behind and known[behind], BEHIND), (key and _hash(key) & ~3, KEY),
            )
            return [h | kind for h, kind in parts if h != ""]

        found = [[dict(zip(keys, (*n[:5], patterns(*n[5])), strict=True)) for n in own] for own in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(found, node)],
            ["row", "doc_id", "counts", "base", "nodes"],
        )


def _frequency(wanted: np.ndarray | None):
    """Words and pairs of words by hash with their number, summed over a batch; only those of ``wanted`` if given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets, lower=True)
                h = _free(np.concatenate([words.hash, words.grams(2)[1]]))
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                    h = h[wanted[at] == h] if len(wanted) else h[:0]
                held.append(h)
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["word", "times"])

    return run


def patterns_of(spans: DataFrame, docs: DataFrame, rounds: int = ROUNDS, smooth: float = SMOOTH, bound: int = BOUND) -> DataFrame:
    """(instance, confidence) of all seeds and candidates after the rounds."""
    each = spans.select(F.explode("nodes").alias("n")).select("n.*")
    flat = each.select("instance", F.explode("patterns").alias("pattern"))
    edges = cut(flat.groupBy("instance", "pattern").agg(F.count(F.lit(1)).alias("n")), "edges")
    used = edges.groupBy("pattern").agg(F.sum("n").alias("own"))
    used = cut(used.withColumn("word", F.col("pattern").bitwiseAND(F.lit(~3))), "patterns")
    asked = used.where(F.col("pattern").bitwiseAND(F.lit(3)) != KEY).select("word").distinct()
    wanted = None
    if asked.limit(bound + 1).count() <= bound:
        wanted = np.sort(np.array([r.word for r in asked.toLocalIterator()], np.int64))
    words = docs.select("text").mapInArrow(_frequency(wanted), "word long, times long")
    times = words.groupBy("word").agg(F.sum("times").alias("times")).join(asked, "word", "left_semi")
    often = F.when(F.col("pattern").bitwiseAND(F.lit(3)) != KEY, F.col("times"))
    total = used.join(times, "word", "left").select("pattern", F.greatest("own", F.coalesce(often, F.lit(0))).alias("total"))
    total = cut(total, "patterns")
    instances = cut(each.groupBy("instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("places")), "instances")
    score = instances.select("instance", "seed", F.col("seed").cast("double").alias("confidence"))
    for _ in range(rounds):
        held = edges.join(score.select("instance", "confidence"), "instance")
        strength = held.groupBy("pattern").agg(F.sum(F.col("n") * F.col("confidence")).alias("sum")).join(total, "pattern")
        strength = strength.select("pattern", (F.col("sum") / (F.col("total") + smooth)).alias("weight"))
        none = edges.join(strength, "pattern").groupBy("instance").agg(F.sum(F.col("n") * F.log1p(-F.least("weight", F.lit(0.999)))).alias("none"))
        score = cut(instances.join(none, "instance").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.col("none") / F.col("places"))).alias("confidence")), "instances")
    return score


def find(docs: DataFrame, sure: float = SURE, rounds: int = ROUNDS, bound: int = BOUND) -> DataFrame:
    """Per row: doc_id, base counts, base spans as text, and all spans (start, order, stop, kind)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    spans = cut(rows.mapInArrow(_scan, SCHEMA), "pii")
    score = patterns_of(spans, docs, rounds, bound=bound)
    flat = spans.select("row", F.explode("nodes").alias("n")).select("row", "n.*")
    sure_of = score.where(F.col("confidence") >= sure).select("instance")
    more = flat.where("kind < 0").join(sure_of, "instance").select("row", "start", F.lit(4).alias("kind"), "stop")
    every = flat.where("kind >= 0").select("row", "start", "kind", "stop").unionByName(more)
    name = F.array(*map(F.lit, (*KINDS, "id")))[F.col("kind")]
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", F.concat_ws(":", name, "start", "stop").alias("span")))).alias("all"))
    return spans.select("row", "doc_id", "counts", "base").join(listed, "row", "left").drop("row")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The query's columns, and the number of all spans."""
    out = find(docs, **options)
    return out.select(
        "doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("all", lambda s: s["span"]), ","), F.lit("")).alias("spans"),
        F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_spans"),
    )


def brute_base(text: str | None) -> tuple[list[int], str]:
    """The contract's regular expressions as they stand, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == i for _, k, _ in out) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest()
