"""Secrets: the base patterns as they stand, and planted random strings among digests and identifiers."""

import random
import string

import pytest
from llm import corpus

from skirmish.llm import secret_scan as s

PIECES = ["token", "Password", "pass", "wd", "SECRET", "api_key", "ApiKey", "tokeN", "toKen", "=", ":", " = ", "   ", '"', "'", "abcdefgh", "ab1", "A/+=.-_z", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "0123456789abcdef0123456789abcdef", "é", "ſ", "K", "\n", ".", "g"]


@pytest.fixture(scope="module")
def tokens():
    return s.tokenizer(open(s.TOKENS, "rb").read())


def spans(text):
    return [] if not text else [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(","))]


def test_base_spans_are_the_patterns(spark):
    rnd = random.Random(3)
    docs = {d: "".join(rnd.choice(PIECES) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 14))) for d in range(600)}
    docs |= {900: None, 901: "", 902: "token" + " " * 50_000 + "x", 903: "a" * 200_000, 904: "token=" * 30_000 + "b" * 9}
    got = {r.doc_id: r for r in s.digest(corpus.table(spark, docs)).collect()}
    for d, t in docs.items():
        counts, digest = s.brute_base(t)
        r = got[d]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest), t
        listed = spans(r.spans)
        assert [x for x in listed if x[0] != s.ADDED] == sorted(((k, a, b) for k, a, b in listed if k != s.ADDED), key=lambda x: (x[1], s.KINDS.index(x[0])))


def test_random_strings_among_known_ones(spark):
    rnd = random.Random(5)
    planted = {d: "".join(rnd.choices(string.ascii_letters + string.digits, k=rnd.choice((20, 24, 40)))) for d in range(200)}
    docs = {d: f"see {x}, and then go on" for d, x in planted.items()}
    docs |= {d + 1000: f'key "{x}"' for d, x in planted.items()}
    left = [
        "550e8400-e29b-41d4-a716-446655440000", "0123456789ABCDEF0123456789ABCDEF", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
        "internationalization_of_names", "SELECT_FROM_WHERE_1", "getUserByIdentifier2", "2024-12-03T10-20-30Z", "4111-1111-1111-1111", "================",
        "https://example.com/watch/aB3dE5fG7hI9jK1lM3", "aB3dE5fG7hI9jK1lM3@example.com", "erpfertzpfsteinpftzpf", "ñaB3dE5fG7hI9jK1lM3", "a-b-c-d-e-f-g-h-i-j",
    ]
    docs |= {2000 + i: f"so {x} there" for i, x in enumerate(left)}
    got = {r.doc_id: spans(r.spans) for r in s.digest(corpus.table(spark, docs)).collect()}
    hit = sum(got[d] == [(s.ADDED, 4, 4 + len(x))] for d, x in planted.items()) + sum(got[d + 1000] == [(s.ADDED, 5, 5 + len(x))] for d, x in planted.items())
    assert hit >= 0.98 * 2 * len(planted)
    assert {x: got[2000 + i] for i, x in enumerate(left)} == {x: [] for x in left}


def test_one_long_run_is_linear(tokens):
    rnd = random.Random(6)
    run = "".join(rnd.choices(string.ascii_letters + string.digits, k=1_000_000))
    assert s.random_spans(run, [], tokens) and s.efficiency(tokens, "the same words again ") > 3
    text = " ".join(run[i : i + 20] for i in range(0, len(run), 20))
    assert len(s.random_spans(text, s.base_spans(text), tokens)) > 45_000


def test_known_values_and_redaction(spark):
    a, b = "aB3dE5fG7hI9jK1lM3nO", "Zz91Kq27Lw83Xc46Vb50"
    docs = {1: f"first {a} here", 2: f"second {b} there {a}", 3: None, 4: "token = 'abcdefgh1' AKIAABCDEFGH1234 x"}
    df = corpus.table(spark, docs, corpus.awkward_rows(docs))
    known = spark.createDataFrame([(a,), (a,), (None,)], "value string")
    got = [(r.doc_id, r.n_random) for r in s.digest(df, known=known).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 1), (3, 0), (4, 0), (None, 0)]
    out = s.redact(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "second [SECRET] there [SECRET]" and texts[3] is None and texts[4] == "[SECRET]' [SECRET] x"


def test_empty_table_and_size_of_the_vocabulary(spark, tmp_path):
    assert s.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    large = tmp_path / "x"
    large.write_bytes(b"YQ== 0\n" * (s.VOCABULARY // 7 + 1))
    with pytest.raises(ValueError):
        s.find(corpus.table(spark, {1: "x"}), tokens=str(large))
