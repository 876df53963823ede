"""Operators with an exact result against a plain statement of their rule."""

import hashlib
import re
from collections import Counter

import pytest
from llm import corpus

from skirmish.llm import decontam, jaccard, licenses, lines, mixing, outliers, pii, substring
from skirmish.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("frequent", [3, 2000])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows(spark, seed, frequent):
    docs = corpus.texts(seed)
    out = substring.remove_repeats(corpus.table(spark, docs), frequent=frequent)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()}
    assert got == substring.brute(docs)


def test_repeated_windows_with_awkward_rows(spark):
    docs = corpus.texts(3, 30)
    out = substring.digest(corpus.table(spark, docs, corpus.awkward_rows(docs)))
    want = substring.brute(docs)
    seen = Counter()
    for r in out.collect():
        seen[r.doc_id] += 1
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert seen[None] == 1 and sum(seen.values()) == len(docs) + 2


def test_automaton_statistics():
    sequence = list("abcabcabxabcabc")
    got = substring.Automaton().read(sequence)
    for i in range(len(sequence)):
        ends = [n for n in range(i + 2) if any(sequence[j - n + 1 : j + 1] == sequence[i - n + 1 : i + 1] for j in range(n - 1, i)) or n == 0]
        assert got[i] == max(ends)


@pytest.mark.parametrize("rare", [1, 32])
def test_jaccard_components(spark, rare):
    docs = corpus.texts(4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(corpus.table(spark, docs), rare=rare).collect()}
    assert got == jaccard.brute(docs)


def test_jaccard_in_a_loose_group_of_near_copies(spark):
    """Copies around the limit: many are not linked with the first, some with no other."""
    import random

    rnd = random.Random(12)
    base = corpus.words(rnd, 170, 10_000)
    docs = {}
    for d in range(70):
        words = list(base)
        for _ in range(rnd.randint(0, 7)):
            words[rnd.randrange(len(words))] = f"n{rnd.random()}"
        docs[d] = " ".join(words)
    want = jaccard.brute(docs)
    assert 1 < len({c for _, c in want.values()}) < 70
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(corpus.table(spark, docs)).collect()}
    assert got == want


def test_jaccard_keeps_one_of_each_group(spark):
    docs = corpus.texts(5, 40)
    df = corpus.table(spark, docs, corpus.awkward_rows(docs)[:1])
    kept = jaccard.dedup(df)
    assert kept.columns == df.columns
    component = jaccard.brute(docs)
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d in docs if component[d][1] == d}


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 14), (2, 1 << 14), (1, 2)])
def test_lines_within_edits(spark, seed, hot):
    import random

    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab éx|") for _ in range(rnd.randint(15, 60))) for _ in range(25)]

    def edited(x):
        x = list(x)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(x) + 1)
            x[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
        return "".join(x)

    docs = {d: None if d % 17 == 3 else "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(0, 6))) for d in range(90)}
    got = {r.doc_id: list(r.removed) for r in lines.digest(corpus.table(spark, docs), hot=hot).collect()}
    assert got == lines.brute(docs)
    out = lines.dedup(corpus.table(spark, docs))
    for r in out.collect():
        kept = docs[r.doc_id]
        if kept is not None:
            kept = "\n".join(x for i, x in enumerate(kept.split("\n")) if i not in got[r.doc_id])
        assert r.text == kept


def _key_rows(keys, rnd):
    """Sorted rows (key, id, sign) as the task meets them, and the pairs of ids wanted."""
    rows, want, next_id = [], set(), 1
    for key, (n_index, n_probe) in enumerate(keys):
        own = []
        for probe in [0] * n_index + [1] * n_probe:
            own.append((key, next_id, (rnd.getrandbits(5) * 0x111111111111 << 1) | probe))
            next_id += 1
        want |= {(x[1], y[1]) for i, x in enumerate(own) for y in own[i + 1 :] if not x[2] & 1 and ((x[2] ^ y[2]) >> 1).bit_count() <= 8}
        rows += own
    return rows, want


@pytest.mark.parametrize(("hot", "size"), [(4, 3), (4, 50), (7, 1000), (1000, 10)])
def test_keys_of_many_lines_are_dealt(spark, hot, size):
    """Keys with few and many index rows over few and many probes, in batches that end anywhere."""
    import random

    import pyarrow as pa

    rnd = random.Random(hot)
    rows, want = _key_rows([(3, 0), (0, 9), (1, 30), (20, 15), (2, 60), (40, 0), (4, 4), (9, 1), (25, 70)], rnd)
    table = [pa.RecordBatch.from_pylist([dict(zip(("key", "id", "sign"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
    met = [r for b in lines._candidates(2, hot)(iter(table)) for r in b.to_pylist()]
    near = {(r["a"], r["b"]) for r in met if r["block"] is None}
    dealt = {r["key"] for r in met if r["block"] is not None}
    assert dealt == {k for k, n in enumerate([3, 0, 1, 20, 2, 40, 4, 9, 25]) if n > hot}
    assert near == {p for p in want if next(r[0] for r in rows if r[1] == p[0]) not in dealt}
    got = lines._pairs(spark.createDataFrame(rows, "key long, id long, sign long").repartition(3), 2, hot).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_a_large_key_in_blocks(spark):
    """Twelve blocks of one key give the pairs that one task finds."""
    import random

    rnd = random.Random(3)
    bases = [rnd.getrandbits(62) for _ in range(400)]
    rows = [(1, i, (bases[i % 400] ^ 1 << rnd.randrange(62)) << 1 | (i > 4000)) for i in range(6000)]
    keys = spark.createDataFrame(rows, "key long, id long, sign long").repartition(5)
    got = [(r.a, r.b) for r in lines._pairs(keys, 2, 500).collect()]
    assert len(got) > 20_000 and sorted(got) == sorted((r.a, r.b) for r in lines._pairs(keys, 2, 1 << 14).collect())


def test_edit_automaton():
    assert lines.within("kitten", "sitten", 1) and not lines.within("kitten", "sitting", 2)
    assert lines.within("kitten", "sitting", 3) and lines.within("", "ab", 2) and not lines.within("", "abc", 2)


def test_templates(spark):
    items = {
        1: "Alice said that Tom has 12 apples and gives 5 apples to Mary how many of the 12 apples does Tom keep now .",
        2: "short item of 4 words",
        3: None,
        4: "",
    }
    docs = {
        1: "so , alice said that Tom has 12 apples and gives 5 apples to Mary how many of the 12 apples does Tom keep now . more",
        2: "and said that Bob has 31 apples and gives 7 apples to Eve how many of the 31 apples does Bob keep now .",
        3: "and said that Bob has 31 apples and gives 7 apples to Eve how many of the 33 apples does Bob keep now .",
        4: "hm a short item of 9 words yes",
        5: None,
        6: "",
    }
    a, b = corpus.table(spark, docs), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(1, 1, 0), (2, 1, 4), (4, 2, 1)}
    assert {(r.doc_id, r.item_id, r.changed) for r in decontam.digest(a, b).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontam.matches(a, b, bound=0).collect()} == {x[:2] for x in want}
    assert {(1, 1), (4, 2)} <= decontam.brute(docs, items)
    assert {r.doc_id for r in decontam.decontaminate(a, b).collect()} == {3, 5, 6}


def test_edited_and_partial_copies(spark):
    """A changed word in a short item, an inserted and a removed one, two changed ones, a number in two words, the first half."""
    import random

    rnd = random.Random(12)
    long, short = corpus.words(rnd, 37, 5000), corpus.words(rnd, 15, 5000)
    said = [*(f"q{w}" for w in long[:20]), "25", *(f"q{w}" for w in long[20:])]
    table = [w + " xx 7 yy" for w in "abcdef"]  # its template repeats, so that neighbouring diagonals hit as well
    items = {1: " ".join(long), 2: " ".join(short), 3: " ".join(said), 4: " ".join(["3 aa bb cc", "5 aa bb cc", "7 aa bb cc", "9 aa bb cc"])}
    docs = {
        1: [*long[:18], "more", *long[18:]], 2: [*long[:18], *long[19:]], 3: [*long[:12], "other", *long[13:24], "other", *long[25:]], 4: long[:18],
        5: [*short[:7], "other", *short[8:]], 6: [*said[:20], "twenty", "five", *said[21:]], 7: items[4].split(), 8: long[:6] + table, 9: short[:6],
    }
    texts = {d: "go on " + " ".join(x) + " and on" for d, x in docs.items()}
    df, b = corpus.table(spark, texts), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.digest(df, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)} and got[7, 4].changed == 0
    assert all(r.occurrences == 1 for r in got.values()) and got[1, 1].share == 1.0


def test_names_at_sentence_starts_and_other_layouts(spark):
    item = "Natalia sold clips to most friends during that trip early . Natalia then asked Tom about more of these clips ."
    items = {1: item, 2: "after that long walk everybody wanted Alice near Berlin with Carol under Dora by Erika"}
    docs = {
        1: "x . " + item.replace("Natalia", "Maria"),
        2: "x " + item.lower(),
        3: "x y " + items[2].replace(" ", "\n"),
        4: "x . " + item.replace("Natalia", "Maria").replace("clips ", "shells ").replace("trip", "stay").replace("asked", "told").replace("more", "less"),
        5: "x . " + item.replace("Natalia", "Maria").replace(" ", "\n"),
    }
    df, b = corpus.table(spark, docs), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in decontam.digest(df, b).collect()}
    assert got == {(1, 1): 1, (2, 1): 0, (3, 2): 0, (5, 1): 1}


def test_two_texts_of_an_item(spark):
    """Both are searched for, whatever they share; equal rows of items and documents count once, empty tables give nothing."""
    import random

    rnd = random.Random(5)
    one, two = (" ".join(corpus.words(rnd, 30, 5000)) for _ in range(2))
    b = spark.createDataFrame([(7, one), (7, two), (7, two), (8, None), (None, one), (9, "")], "item_id long, text string")
    df = corpus.table(spark, {1: "a " + one, 2: "a " + two + " b", 3: one + " x y z " + two, 4: "", 5: None})
    for how in ({}, {"bound": 0}):
        got = sorted((r.doc_id, r.item_id, r.place) for r in decontam.matches(df.union(df), b, **how).collect())
        assert got == [(1, 7, 1), (2, 7, 1), (3, 7, 0), (3, 7, 33)]
    assert {r.doc_id: r.occurrences for r in decontam.digest(df, b).collect()} == {1: 1, 2: 1, 3: 2}
    assert {r.doc_id for r in decontam.decontaminate(df, b).collect()} == {4, 5}
    assert decontam.decontaminate(df.limit(0), b).count() == 0


def test_lower_limit_is_an_error(spark):
    df = corpus.table(spark, {1: "a b c"})
    for percent in (79, 101):
        with pytest.raises(ValueError, match="percent"):
            jaccard.classes(df, percent)
        with pytest.raises(ValueError, match="percent"):
            jaccard.dedup(df, percent)


def test_mix(spark):
    docs = corpus.texts(6, 80)
    df = corpus.table(spark, docs)
    plan = rows(mixing.plan_mix(df))
    size = {d: len(WORD.findall(t or "")) for d, t in docs.items()}
    assert {d: r["size"] for d, r in plan.items()} == size
    targets = {(r.source_size, r.target) for r in plan.values()}
    assert sum(t for _, t in targets) == pytest.approx(1.5 * sum(size.values()))
    assert all(t <= 2 * s + 1e-9 for s, t in targets) and all(0 <= r.copies <= 2 for r in plan.values())
    out = mixing.mix(df)
    assert set(out.columns) == set(df.columns)
    copies = Counter(r.doc_id for r in out.collect())
    assert copies == Counter({d: r.copies for d, r in plan.items() if r.copies})
    assert Counter(r.doc_id for r in mixing.mix(df).collect()) == copies


def test_base_statistics(spark):
    docs = corpus.texts(7, 60) | {1001: "a b c\na b c\n \n* $5 |x|", 1002: "x y x y x y"}
    got = rows(outliers.digest(corpus.table(spark, docs)))
    for d, t in docs.items():
        t = t or ""
        w = WORD.findall(t)
        three = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        held = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(again))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_the_rest_stays(spark):
    import random

    rnd = random.Random(8)
    docs = {d: " ".join(corpus.words(rnd, 120, 5000)) for d in range(150)}
    docs |= {d: " ".join(f"{w}$$$" for w in corpus.words(rnd, 120, 5000)) for d in range(150, 156)}
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in docs.items()], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in outliers.digest(df).collect() if not r.kept} == set(range(150, 156))


def test_repetition_alone_is_an_outlier(spark):
    """A document of ordinary words, extreme in repeated lines and words only."""
    import random

    rnd = random.Random(10)
    docs = {d: "\n".join(" ".join(corpus.words(rnd, 6, 5000)) for _ in range(20)) for d in range(150)}
    lines = docs[0].split("\n")
    docs[150] = "\n".join(lines[:15] + lines[:5])
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in docs.items()], "doc_id long, text string, lang string, source string")
    got = rows(outliers.digest(df))
    assert not got[150].base_failed and {d for d, r in got.items() if not r.kept} == {150}


def test_small_groups_are_judged_by_their_language_or_all_rows(spark):
    import random

    rnd = random.Random(11)
    told = [(d, " ".join(corpus.words(rnd, 120, 5000)), "en", f"s{d % 40}") for d in range(200)]
    told += [(d, " ".join(corpus.words(rnd, 120, 5000)), ("xx", None)[d % 2], None) for d in range(200, 206)]
    told += [(d, " ".join(f"{w}$$$" for w in corpus.words(rnd, 120, 5000)), *of) for d, of in ((300, ("en", "s3")), (301, ("xx", None)), (302, (None, "new")))]
    got = rows(outliers.digest(spark.createDataFrame(told, "doc_id long, text string, lang string, source string")))
    assert {d for d, r in got.items() if not r.kept} == {300, 301, 302} and all(r.distance is not None for r in got.values())


def test_base_spans_are_the_patterns(spark):
    import random

    rnd = random.Random(9)
    pieces = ["a.b@c.de", "@x.y", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "é", " ", "\n", "12", "+", ".", "-", "x"]
    docs = {d: "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 14))) for d in range(300)} | {900: None}
    got = rows(pii.digest(corpus.table(spark, docs)))
    for d, t in docs.items():
        counts, digest = pii.brute_base(t)
        r = got[d]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest), t


def test_contexts_find_new_identifiers(spark):
    docs = {d: f"ordinary words here {d}\nplease note token = \"{d:08x}ab12cd34\" and go on" for d in range(40)}
    docs |= {100: 'badge = "zz81xk27qq" was seen', 101: "version 20 of the plan"}
    got = rows(pii.digest(corpus.table(spark, docs)))
    text = docs[100]
    assert got[100].spans == f"id:{text.index('zz81')}:{text.index('zz81') + 10}" and got[101].spans == ""


def test_short_identifiers_and_runs(spark):
    """Values of under eight characters and of several tokens behind words that known ones share; common numbers stay."""
    docs = {d: f"his badge no AB-{d}77 pwd=AB-{d}77 was shown" for d in range(10, 40)} | {50: "his badge no XY-1234 was shown", 51: "his badge no 12 34 56 78 was shown"}
    docs |= {d: f"there were {d % 4} boats in {2000 + d % 7}, and no {d % 4} more" for d in range(100, 200)} | {60: "his badge no 3 was shown", 61: "his badge no 1 2 3 4 5 6 7 8"}
    got = {d: [docs[d][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for d, r in rows(pii.digest(corpus.table(spark, docs))).items()}
    assert got[50] == ["XY-1234"] and got[51] == ["12 34 56 78"]
    assert got[10] == ["pwd=AB-1077"] or got[10] == ["AB-1077", "pwd=AB-1077"]
    assert got[60] == [] and got[61] == [] and not any(got[d] for d in range(100, 200))


def test_candidates_of_a_text():
    def found(text):
        return [text[n[0] : n[1]] for n in pii.nodes(text, pii.base_spans(text))]

    assert found("no 12 34, 56 78 (9 10) AB1 abcd1234 5") == ["12 34", "56 78", "9 10", "AB1", "abcd1234", "5"]
    assert found("1 2 3 4 5 6 7") == list("1234567") and found("at 1.2.3.4 12 é3") == ["1.2.3.4", "12 é3"]
    assert pii.nodes("a b 12 c", [])[0][5] == ("a", "b", "c", "") and pii.nodes("12", [])[0][5] == ("", "", "", "")


def test_keyed_secrets_of_any_value(spark):
    """Values without digits or under eight characters, glued to their key or behind one that other secrets share."""
    docs = {1: "login password=correcthorse and go", 2: "so pwd=ab1, then", 3: "a secret=abcdefghij here", 4: "no password at all", 5: "the token= is empty"}
    docs |= {d: f"set password: zz{d}yy{d}xx now" for d in range(10, 40)} | {50: "set password: hunter2 now"}
    got = {d: [docs[d][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for d, r in rows(pii.digest(corpus.table(spark, docs))).items()}
    want = {1: ["password=correcthorse"], 2: ["pwd=ab1"], 3: ["secret=abcdefghij"], 4: [], 50: ["hunter2"]}
    assert {d: got[d] for d in want} == want and got[10] == ["zz10yy10xx"]


def test_license_phrases_and_diagonals(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    docs = {
        1: "x Under the MIT License y under-the-mit-license",
        2: gpl,
        3: "Apache license, version 2 (cc by nc) apache license version 20",
        4: None,
        5: "this work is licensed to me",
        6: "this program is FREE software; you can well redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    }
    got = rows(licenses.digest(corpus.table(spark, docs)))
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "mit")
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "gpl-3", 1.0)
    assert (got[3].n_base, got[3].base_labels) == (2, "apache-2,cc-by-nc")
    assert (got[4].n_words, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[5].labels == "" and "agpl-3" in got[6].labels


def test_words_of_blocks():
    import numpy as np

    texts = ["", " a  bc\t", "ä\nb", "", "bc"]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert w.row.tolist() == [1, 1, 2, 2, 4] and w.first.tolist() == [0, 0, 2, 4, 4, 5]
    assert w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 4
    assert w.joined(0, 2) == b"a bc"


def test_two_texts_under_one_id(spark):
    """Every text is judged by itself; nothing of another text under its doc_id is taken for its own."""
    p, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, p), (2, p), (2, other), (3, None), (3, p), (2, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect())
    assert got == Counter([(1, 30, 0, p), (2, 30, 30, ""), (2, 30, 0, other), (2, 30, 0, other), (3, 0, 0, ""), (3, 30, 30, "")])

    a, b = "the first line of a text that is long enough to count", "something quite different and unique in here"
    rows = [(1, a), (2, a), (2, b), (2, b), (4, f"{b}\n{a}\nshort"), (3, None), (3, f"x\n{a}!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.text) for r in lines.dedup(df).collect()) == Counter([(1, a), (2, ""), (2, b), (2, b), (4, "short"), (3, None), (3, "x")])
    told = Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in lines.digest(df).collect())
    assert told == Counter([(1, 1, ()), (2, 1, (0,)), (2, 1, ()), (2, 1, ()), (4, 3, (0, 1)), (3, 0, ()), (3, 2, (1,))])

    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, gpl), (1, "nothing else here"), (None, gpl), (None, None), (1, gpl)]
    got = Counter((r.doc_id, r.labels, r.score) for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == Counter([(1, "gpl-3", 1.0), (1, "gpl-3", 1.0), (1, "", 0.0), (None, "gpl-3", 1.0), (None, "", 0.0)])


def test_long_texts_of_candidates_are_linear():
    import time

    text = " ".join(f"word{i} ab{i}cd{i:05d}" for i in range(250_000))
    began = time.time()
    assert len(pii.nodes(text, pii.base_spans(text))) > 240_000
    assert time.time() - began < 60


def test_words_counted_by_a_join(spark):
    docs = {d: f"please note token = \"{d:08x}ab12cd34\" and go on" for d in range(30)} | {100: 'badge = "zz81xk27qq" was seen'}
    df = corpus.table(spark, docs)
    one, two = ({r.doc_id: (r.spans, r.n_spans) for r in pii.digest(df, **how).collect()} for how in ({}, {"bound": 0}))
    assert one == two and one[100][1] == 1


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("run", [substring.digest, jaccard.classes, lines.digest, lines.dedup, outliers.digest, mixing.digest, mixing.mix, pii.digest, licenses.digest])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).collect() == []


def test_empty_benchmark(spark):
    docs = corpus.table(spark, corpus.texts(1, 10))
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(docs, nothing).collect() == [] and decontam.decontaminate(docs, nothing).count() == docs.count()
