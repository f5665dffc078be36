"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronofind.llm import byte_dedup, decontamination, language_id, license_scan, mixing, pii, queries, shards, simhash, topk, url_filter, word_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


@pytest.fixture(scope="module")
def docs(spark):
    """A small corpus with all the odd cases, and columns that operators use as names of their own."""
    rng = random.Random(3)
    vocabulary = {"en": "the of and shall river stone with bright".split(), "de": "der und nicht straße über fluss stein hell".split(), "fr": "le et être où rivière pierre avec clair".split()}
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(1, 160))), lang, f"src{rng.choice([0, 0, 0, 1, 2])}"))
    passage = " ".join(f"w{rng.randint(0, 500)}" for _ in range(70))
    rows += [(100, f"a {passage} z", "en", "src0"), (101, f"b {passage} y", "en", "src1"), (102, passage, None, None), (103, None, "en", "src0"), (104, "", "de", "src2"), (105, " \t\n", "fr", None)]
    rows += [(106, "12 34 !!", "en", "src0"), (None, passage, "en", "src0"), (None, None, None, None), (107, "x " * 30_000, "en", "src1"), (108, "é" * 5_000, "fr", "src1")]
    rows += [rows[5]] * 3 + [(5, "another text of a repeated id", "en", "src0")] + [(200 + i, rows[7][1], "en", "src0") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("shard", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("score", F.lit(None).cast("int")).withColumn("fp", F.lit(2)).withColumn("size", F.lit("q")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def brute_windows(items, window, join):
    """(id, size, removed, spans, kept) by row; items: (id, sequence)."""
    first = {}
    for i, w in items:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, LAST), LAST if i is None else i)
    for i, w in items:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (LAST if i is None else i):
                keep[j : j + window] = [False] * window
        spans = sum(not k and (j == 0 or keep[j - 1]) for j, k in enumerate(keep))
        yield i, len(w), keep.count(False), spans, hashlib.sha256(join([x for x, k in zip(w, keep) if k])).hexdigest()


def test_word_dedup(docs, rows):
    items = [(i, WORD.findall(t or "")) for i, t in rows]
    same(word_dedup.dedup_words(docs).collect(), [(i, n, r, h) for i, n, r, _, h in brute_windows(items, 50, lambda w: " ".join(w).encode())])
    assert word_dedup.dedup_words(docs.limit(0)).count() == 0


def test_byte_dedup(docs, rows):
    items = [(i, (t or "").encode()) for i, t in rows]
    same(byte_dedup.dedup_bytes(docs).collect(), list(brute_windows(items, 50, bytes)))
    assert byte_dedup.dedup_bytes(docs.limit(0)).count() == 0


def test_dedup_of_hot_names_and_odd_ids(spark, monkeypatch):
    """A passage that most documents hold, at a limit that makes its names hot; then all ids null, and one id for all."""
    monkeypatch.setattr(shards, "HOT", 6)
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(60))
    words = lambda n: " ".join(f"w{rng.randint(0, 99)}" for _ in range(n))
    texts = [f"{words(rng.randint(0, 30))} {passage} {words(rng.randint(0, 30))}" for _ in range(60)] + ["ab " * 90] * 9 + [words(80) for _ in range(5)] * 2
    for ids in (lambda i: i % 50, lambda i: None, lambda i: 7, lambda i: None if i % 2 else 3):
        rows = [(ids(i), t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        same(byte_dedup.dedup_bytes(df).collect(), list(brute_windows([(i, t.encode()) for i, t in rows], 50, bytes)))
        items = [(i, WORD.findall(t)) for i, t in rows]
        same(word_dedup.dedup_words(df).collect(), [(i, n, r, h) for i, n, r, _, h in brute_windows(items, 50, lambda w: " ".join(w).encode())])


def test_word_dedup_is_not_fooled_by_made_up_words(spark):
    """Words whose polynomial hashes modulo 2^64 are equal for every odd base, as the Thue-Morse sequence makes them."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    same_words = [f"w{i}" for i in range(49)]
    rows = [(k, " ".join([*same_words, "".join("ab"[b ^ k] for b in bits)])) for k in (0, 1)]
    got = word_dedup.dedup_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_exchange_rows_grow_with_the_text():
    """One row per shard and bucket: with shards that grow with the root of the text, at most one for ROW_BYTES of it."""
    for total in (1 << 28, 1 << 32, 1 << 36, 10**14):
        n = -(-total // max(shards.SHARD_BYTES, int((shards.ROW_BYTES * total) ** 0.5)))
        assert n * n <= 1.01 * total / shards.ROW_BYTES + 2 * n


def test_interleave_orders_by_characters():
    rng = np.random.default_rng(1)
    parts, strings = [], []
    for _ in range(3):
        some = [bytes(rng.integers(97, 100, rng.integers(18, 40)).astype(np.uint8)) for _ in range(6)]
        strings.append(b"".join(some))
        parts.append((byte_dedup.Transform(np.frombuffer(strings[-1], np.uint8), np.array([len(s) for s in some]), 24), some))
    suffixes = [s[j:] for _, some in parts for s in some for j in range(len(s))]
    place = np.concatenate([p.place + sum(len(x) for x in strings[:k]) for k, (p, _) in enumerate(parts)])
    for step, (order, interval) in enumerate(byte_dedup.interleave([p for p, _ in parts], 18), 1):
        n = 2 * step
        heads = [suffixes[i][:n] for i in place[order]]
        assert heads == sorted(heads) and len(set(zip(heads, interval.tolist()))) == len(set(heads)) == len(set(interval.tolist()))
        every = Counter(s[:n] for s in suffixes if len(s) >= n)
        assert Counter(heads) == {h: c for h, c in every.items() if c > 1}


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    every = sorted(set(fps))
    up = {x: x for x in every}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    return {x: root(x) for x in every}


def test_simhash(docs, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[roots[f]] = min(low.get(roots[f], LAST), i)
    same(simhash.near_duplicates(docs).collect(), [(i, f"{f:016x}", low.get(roots[f])) for (i, _), f in zip(rows, fps)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_cuts_large_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 40)
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3) for _ in range(25)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    stars = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))).collect()
    got = {r.a: r.b for r in stars}
    groups = defaultdict(set)
    for f in fps:
        groups[got.get(signed[f], signed[f])].add(f)
    want = defaultdict(set)
    for f, r in brute_components(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_language_id(docs):
    learned = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text", F.col("lang").alias("truth")), learned).collect()
    for r in found:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    mine = [r for r in found if r.doc_id is not None and r.doc_id < 90 and len(r.text) > 60 and r.truth]
    assert sum(r.lang_pred == r.truth for r in mine) / len(mine) > 0.95
    nothing = language_id.learn(docs.limit(0))
    assert nothing.predict("some text") == ("und", 0.0) and language_id.predict(docs.limit(0).select("text"), nothing).count() == 0


def brute_grams(text):
    """N-grams of a text by count and then by code points."""
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        p = f"_{w}_"
        counts.update(w)
        counts.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return counts, lambda c: sorted(c, key=lambda g: (-c[g], code(g)))[:400]


def brute_languages(learned, texts):
    """(language, score) of texts; learned: (text, language)."""
    sums = defaultdict(Counter)
    for text, lang in learned:
        if text is not None and lang is not None:
            sums[lang].update(brute_grams(text)[0])
    ranks = {lang: {g: i for i, g in enumerate(brute_grams("")[1](c))} for lang, c in sorted(sums.items()) if c}
    for text in texts:
        counts, ranked = brute_grams(text)
        mine = ranked(counts)
        if not mine or not ranks:
            yield "und", 0.0
            continue
        far = {lang: sum(abs(i - r[g]) if g in r else 400 for i, g in enumerate(mine)) for lang, r in ranks.items()}
        best = min(far, key=far.get)
        yield best, 1 - far[best] / (400 * len(mine))


def test_language_id_against_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang", language_id.held_out().alias("out")).collect()
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    # the column `score` of the fixture gives way
    got = language_id.predict(docs, profiles)
    assert sorted(got.columns) == sorted([*docs.columns, "lang_pred"])
    want = brute_languages([(r.text, r.lang) for r in rows if not r.out], [r.text for r in rows])
    same([(r.doc_id, r.text, r.lang_pred, round(r.score, 12)) for r in got.collect()], [(r.doc_id, r.text, lang, round(score, 12)) for r, (lang, score) in zip(rows, want)])


def test_language_profiles_are_ranked_counts(spark):
    texts = ["abba ab", "Zebra über², naïve", "ab"]
    learned = language_id.learn(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), profile_size=12)
    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower().replace("²", " ")):
            p = f"_{w}_"
            counts.update(w)
            counts.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = sorted(counts, key=lambda g: (-counts[g], code(g)))[:12]
    assert [int(learned.grams[i]) for i in np.argsort(learned.ranks[:-1, 0])] == [code(g) for g in want]


def test_decontamination(spark, docs):
    rng = random.Random(8)
    item = " ".join(f"q{rng.randint(0, 900)}" for _ in range(40))
    words = item.split()
    edited = " ".join(w if i % 7 else "changed" for i, w in enumerate(words))
    some = spark.createDataFrame([(900, f"before {item.upper()}, after"), (901, f"so {edited} end"), (902, " ".join(words[:4]) + " and more"), (903, None)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "qa qb"), (None, item)], "item_id long, text string").withColumn("score", F.lit(1))
    found = decontamination.contaminated(docs.select("doc_id", "text").unionByName(some), tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (900, 901) for i in (1, None)}
    assert {r.score for r in found if r.doc_id == 900} == {1.0} and {(r.first_word, r.end_word) for r in found if r.doc_id == 900} == {(1, 41)}
    assert decontamination.contaminated(docs.limit(0), tests).count() == 0 and decontamination.contaminated(docs, tests.limit(0)).count() == 0


def brute_align(a, b):
    best, h = 0, np.zeros((len(b) + 1, len(a) + 1), int)
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 30)), rng.integers(1, 6, rng.integers(1, 20))
        score, first, end = decontamination.align(a, b)
        assert score == brute_align(a, b) == brute_align(a[first:end], b)
        assert decontamination.most(a, b) >= brute_align(a, b)


def test_wide_vocabularies_are_numbered():
    """Codes that don't fit in 62 bits name the same n-grams as those that do."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"v{rng.randint(0, 9)}" for _ in range(rng.choice([2, 5, 40])))) for i in range(30)]
    narrow, wide = decontamination.Items(rows, 3), decontamination.Items([*rows, (99, " ".join(f"z{i}" for i in range(1_700_000)))], 3)
    assert narrow.shorter is None and wide.shorter is not None
    for _ in range(20):
        text = " ".join(f"v{rng.randint(0, 12)}" for _ in range(300))
        found = [{(int(p), tuple(k for k in items.of[g] if k < 30)) for p, g in zip(*items.hits(items.numbers(text)))} for items in (narrow, wide)]
        assert found[0] == found[1] and found[0]


def test_alignment_memory_grows_with_the_passage_alone():
    passage = np.random.default_rng(1).integers(1, 50, 2_000_000)
    item = passage[1_000_000:1_000_060].copy()
    tracemalloc.start()
    assert decontamination.align(passage, item) == (120, 1_000_000, 1_000_060)
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_decontamination_against_brute_force(spark):
    """Every document against every item, whole: passages that hold no three words of the item in a row apart."""
    rng = random.Random(6)
    items = {i: [f"i{i % 5}w{rng.randint(0, 40)}" for _ in range(rng.choice([2, 8, 30, 60]))] for i in range(12)}
    texts = []
    for d in range(150):
        words = [f"o{rng.randint(0, 99)}" for _ in range(rng.randint(0, 80))]
        for i in rng.sample(sorted(items), rng.choice([0, 1, 1, 2])):
            share = rng.choice([0, 0.1, 0.2, 0.3, 0.4])
            words += [w if rng.random() >= share else rng.choice([f"e{rng.randint(0, 99)}", f"{w} e1"]) for w in items[i][rng.choice([0, 0, len(items[i]) // 3]) :]]
            words += [f"o{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(words))
    texts += ["", " ".join(items[3] * 2000), None, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(df, tests).collect()}
    want = {}
    for d, t in enumerate(texts):
        passage = decontamination.words_of(t)
        held = {tuple(passage[j : j + n]) for n in (2, 3) for j in range(len(passage))}
        numbers = {w: n for n, w in enumerate(dict.fromkeys([*passage, *sum(items.values(), [])]))}
        for i, w in items.items():
            if any(tuple(w[j : j + min(3, len(w))]) in held for j in range(len(w) - min(3, len(w)) + 1)):
                score = decontamination.align(np.array([numbers[x] for x in passage]), np.array([numbers[x] for x in w]))[0]
                if score >= len(w):
                    want[d, i] = score / (2 * len(w))
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(set(want) - set(got)) <= 0.02 * len(want) and len(want) > 100


def test_decontamination_recall_of_edited_copies():
    """Copies with words changed, dropped or put in at random, in long texts: at least 0.9 of those that align are found."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"i{i}w{j}" for j in range(rng.randint(19, 59)))) for i in range(60)]
    items = decontamination.Items(rows, decontamination.SEED_WORDS)
    chosen = decontamination.seeds(items, {g: 50 for g in range(items.codes.size)}, 10_000, decontamination.RARE_SHARE)
    for share in (0.1, 0.2, 0.3):
        aligned = hit = 0
        for k, text in rows:
            for _ in range(5):
                copy = [x for w in text.split() for x in ([w] if rng.random() >= share else rng.choice([["e"], [], [w, "e"]]))]
                w = items.numbers(" ".join(["before"] * 200 + copy + ["after"] * 200))
                if decontamination.align(w, items.words[k])[0] >= decontamination.MIN_SCORE * 2 * items.words[k].size:
                    aligned += 1
                    hit += k in {x[0] for x in decontamination.passages(items, chosen, w, decontamination.MIN_SCORE)}
        print("edits", share, "aligned", aligned, "of 300, found", hit)
        assert aligned > 200 and hit >= 0.9 * aligned


def edited_copies(rng, words):
    """Partial and edited copies of an item."""
    n = len(words)
    yield from (words[n // 2 :], words[: n - n // 2], words[n - n * 55 // 100 :], words[n // 4 : n - n // 4])
    yield from ([f"x{i}" if i % 4 == k else w for i, w in enumerate(words)] for k in range(4))
    yield [f"x{i}" if rng.random() < 0.2 else w for i, w in enumerate(words)]


def test_decontamination_finds_all_parts_of_leaked_items():
    """Every n-gram of the items is in too many documents to be rare, equally or the last ones the most."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"i{i}w{j}" for j in range(rng.randint(19, 59)))) for i in range(40)]
    items = decontamination.Items(rows, decontamination.SEED_WORDS)
    lost = []
    for held in ({g: 50 for g in range(items.codes.size)}, {g: 50 + g for g in range(items.codes.size)}):
        chosen = decontamination.seeds(items, held, 10_000, decontamination.RARE_SHARE)
        for k, text in rows:
            for c, copy in enumerate(edited_copies(rng, text.split())):
                w = items.numbers(" ".join(["before"] * 30 + copy + ["after"] * 30))
                if brute_align(w, items.words[k]) >= decontamination.MIN_SCORE * 2 * items.words[k].size and k not in {x[0] for x in decontamination.passages(items, chosen, w, decontamination.MIN_SCORE)}:
                    lost.append((k, c))
    assert lost == []


#: How the known licence sentences are written in notices.
PUNCTUATED = {
    "mit.grant": "Released under the MIT License.",
    "mit.grant2": "This project is licensed under the MIT License.",
    "mit.licensed": "Licensed under the MIT license.",
    "mit.distributed": "Distributed under the MIT License.",
    "mit.name": "The MIT License (MIT)",
    "mit.title": "MIT License",
    "mit.permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit.liability": "IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.",
    "apache2.grant": "Licensed under the Apache License, Version 2.0.",
    "apache2.grant2": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2.released": "Released under the Apache License, Version 2.0.",
    "apache2.short": "Licensed under the Apache License 2.0.",
    "apache2.use": "you may not use this file except in compliance with the License.",
    "apache2.copy": "You may obtain a copy of the License at",
    "apache2.basis": 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2.see": "See the License for the specific language governing permissions and\nlimitations under the License.",
    "gpl3.work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3.licensed": "Licensed under the GNU General Public License version 3.",
    "gpl3.released": "Released under the GNU General Public License version 3.",
    "gpl2.work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl2.licensed": "Licensed under the GNU General Public License version 2.",
    "gpl3.redistribute": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "gpl2.redistribute": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl.details": "See the\nGNU General Public License for more details.",
    "lgpl3.licensed": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl3.licensed": "Licensed under the GNU Affero General Public License, version 3.",
    "bsd.redistribution": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "bsd.source": "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "bsd.binary": "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "bsd.names": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "bsd3.licensed": "Licensed under the BSD 3-Clause License.",
    "bsd2.licensed": "Licensed under the BSD 2-Clause License.",
    "bsd.warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.',
    "isc.permission": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "isc.warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.',
    "zerobsd.permission": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the\nuse of this software.",
    "zlib.permission": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "bsl.permission": 'Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:',
    "lgpl21.redistribute": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "lgpl3.redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3.redistribute": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "isc.licensed": "Licensed under the ISC License.",
    "mpl2.subject": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2.licensed": "Licensed under the Mozilla Public License, version 2.0.",
    "ccbync4.licensed": "Licensed under CC BY-NC 4.0.",
    "ccby4.licensed": "Licensed under CC BY 4.0.",
    "ccbysa4.licensed": "Licensed under CC BY-SA 4.0.",
    "ccbysa3.licensed": "Licensed under CC BY-SA 3.0.",
    "ccby4.work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4.work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0.dedicated": "This work is dedicated to the public domain under CC0 1.0.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "reserved.all": "All rights reserved.",
    "spdx.mit": "// SPDX-License-Identifier: MIT",
    "spdx.apache2": "# SPDX-License-Identifier: Apache-2.0",
    "spdx.gpl2": "/* SPDX-License-Identifier: GPL-2.0-only */",
    "spdx.gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx.bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx.bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx.mpl2": "SPDX-License-Identifier: MPL-2.0",
}


#: Forms of the templates.
VARIED = {
    "bsd.names_of": "3. Neither the name of Foo Bar Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "bsd.warranty_by": 'THIS SOFTWARE IS PROVIDED BY JO DOE "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache2.work_of": "Licensed to the Foo Foundation (FF) under one\nor more contributor license agreements.",
    "copyright.line": "Copyright (c) 2020 2021 Jo Doe",
}


def test_licenses_in_comments_and_odd_spacing():
    scan = license_scan.Scanner().scan
    assert [x[:3] for x in scan("All rights\nreserved.")] == [x[:3] for x in scan("All   rights  reserved.")] == [("All-rights-reserved", "reserved.all", 1)]
    assert [x[:2] for x in scan("This work is dedicated to the public\ndomain under CC0 1.0.")] == [("CC0-1.0", "cc0.dedicated")]
    assert scan("Foo bar.\n  Released under the MIT License.\nmore") == [("MIT", "mit.grant", 1, 11, 42)]
    assert [x[:2] for x in scan("Released under the\nMIT License\n")] == [("MIT", "mit.grant")]
    words = PUNCTUATED["mit.permission"].split()
    for mark in ("# ", "    // ", " * ", "\t;; " + " " * 200):
        assert [x[:2] for x in scan("x = 1\n\n" + "".join(f"{mark}{w}\n" for w in words) + "\n")] == [("MIT", "mit.permission")], mark
        whole = "\n".join(mark + line for k in ("mit.title", "mit.permission", "mit.notice", "mit.warranty", "mit.liability") for line in [*PUNCTUATED[k].split("\n"), ""])
        assert [x[:3] for x in scan(whole)] == [("MIT", "mit.title", 5)], mark
    for text in ("Released under GPLv3.", "// SPDX-License-Identifier: LGPL-2.1-or-later", "Covered by MPL 2.0", "This project is released under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."):
        assert len(scan(text)) == 1, text


def test_licenses_against_how_the_texts_were_made(spark):
    """Documents put together from notices and other sentences: exactly the notices are found, in order, at their places."""
    rng = random.Random(11)
    # the MPL form goes on with a sentence that is not of the rule
    notices = [(n, ids) for n, ids in license_scan.RULES if all(k in PUNCTUATED and k != "mpl2.subject" for k in ids)]
    other = ["The river is wide.", "Software is hard to write.", "Nothing is licensed here at all.", "Copyright law differs.", "x = 1;", "Permission was not asked!"]
    texts, want = [], []
    for d in range(200):
        text = ""
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                text += " ".join(rng.choices(other, k=rng.randint(3, 60))) + rng.choice(["\n\n", "\n \n"])
            else:
                name, ids = rng.choice(notices)
                # far enough from the notice before for no rule to reach over
                text += " ".join(["Words between notices."] * 20) + "\n\n"
                notice = rng.choice(["\n", "\n\n"]).join(PUNCTUATED[k] for k in ids)
                want.append((d, name, ids[0], len(ids), len(text), len(text) + len(notice)))
                text += notice + "\n\n"
        texts.append(text)
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    same(got, want)


def test_every_license_sentence_and_rule_is_found():
    scanner = license_scan.Scanner()
    assert PUNCTUATED.keys() == license_scan.SENTENCES.keys()
    for k, s in PUNCTUATED.items():
        for text in (s, f"int a;\n{s}\nint b;" if "\n" not in s else f"int a;\n\n{s}\n\nint b;", f"Some words. {s}"):
            assert k in {x[2] for x in scanner.identify(text)}, (k, text)
    for k, s in VARIED.items():
        assert k in {x[2] for x in scanner.identify(f"x\n\n{s}\n")}, k
    made, rules = license_scan.by_rule()
    for licence, (k,) in rules:
        assert [x[0].removesuffix("-or-later") for x in scanner.scan(f"One.\n{made[k]}.\nTwo.")] == [licence.removesuffix("-or-later")], k
    for name, ids in license_scan.RULES:
        text = "\n\n".join((PUNCTUATED | VARIED)[k] for k in ids)
        assert [(x[0], x[1], x[2]) for x in scanner.scan(text)] == [(name, ids[0], len(ids))], (name, ids)
    notice = PUNCTUATED["gpl2.redistribute"]
    assert scanner.scan(f"x\n\n{notice}") == [("GPL-2.0-or-later", "gpl2.redistribute", 1, 3, 3 + len(notice))]


def test_license_scan(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, wrapped), (3, "no license here"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. And then: All rights reserved."), (1, "text\nReleased under the MIT License.\nmore"), (None, "x. " * 5000 + "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rule", F.lit(1))
    found = sorted(((r.doc_id or 0, r.license, r.n_sentences) for r in license_scan.scan_licenses(df).collect()))
    assert found == [(0, "MIT", 1), (1, "MIT", 1), (1, "MIT", 1), (2, "MIT", 3), (6, "All-rights-reserved", 1), (6, "CC-BY-NC-4.0", 1)]
    assert all(license_scan.TRIGGER.search(s) for s in license_scan.SENTENCES.values())
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "https://example.com/de/1", "http://x.net/es/", "http://x.net/ES/", "ftp://y.org/a", "http://spam-farm.org/1", "nothing", None, "http://com/a", "http://foo.com", "http://acom/x", "://", "http://a.org/" + "b/" * 20000, "http://y.org/a"]
    df = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    want = {0: ("www.example.com", "www.example.com/en/", "allow"), 1: ("a.example.com", "example.com/en/", "block"), 2: ("example.com", "com/", "allow"), 3: ("x.net", "net/es/", "block"), 4: ("x.net", None, "allow"), 6: ("spam-farm.org", None, "block"), 7: ("", None, "allow"), 8: ("", None, "allow"), 9: ("com", "com/", "allow"), 10: ("foo.com", None, "allow"), 11: ("acom", None, "allow"), 15: ("www.example.com", "www.example.com/en/", "allow")}
    assert len(got) == 16 and all(got[k] == v for k, v in want.items())
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r.source_size is not None
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in target)
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 48 for s in target)
    assert mixing.mix(docs.limit(0)).count() == 0 and {r.taken for r in mixing.mix(docs.filter("text is null")).collect()} == {0}


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.targets([1, 100, 0], [3, 1, 2]) == pytest.approx([3, 98, 0])
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_blocks_meet_their_slots(n):
    """The inverse permutation tells of each block how many of the slots take it."""
    assert mixing.permuted(mixing.permuted(np.arange(n), n, 5), n, 5, inverse=True).tolist() == list(range(n))
    for slots in (0, 1, n - 1, n, n + n // 2, 3 * n):
        taken = Counter()
        for j in range(slots):
            taken[int(mixing.permuted(np.array([j % n]), n, mixing.slot_key(17, 4, j // n))[0])] += 1
        assert mixing.times(np.arange(n), n, slots, 4, 17).tolist() == [taken[b] for b in range(n)]


def test_mixing_against_brute_force(spark, docs, monkeypatch):
    """The streams, the draws and the slots one by one, from the places that documents get; and in small shards and pieces."""
    for shard, copies in ((1 << 20, 1 << 12), (50, 7)):
        monkeypatch.setattr(mixing, "SHARD_SLOTS", shard)
        monkeypatch.setattr(mixing, "_COPIES", copies)
        got = mixing.placed(docs).collect()
        sizes, aims = {}, {}
        for r in got:
            sizes[r.source], aims[r.source] = r.source_size, r.target
        names = sorted(sizes, key=lambda x: (x is None, x or ""))
        assert [aims[x] for x in names] == pytest.approx(mixing.targets([sizes[x] for x in names], [(1, 2, 3)[i % 3] for i in range(len(names))]))
        blocks = np.array([-(-sizes[x] // 16) for x in names])
        expected = np.array([aims[x] * b / sizes[x] if sizes[x] else 0 for x, b in zip(names, blocks)])
        slots = sum(mixing.shard_counts(expected, 3 * blocks, 17))
        assert abs(slots - expected).max() <= 1 + len(names) * (1 + expected.sum() // shard) ** 0.5
        for s, name in enumerate(names):
            mine = [r for r in got if r.source == name]
            assert len({(r.doc_id, r.hash, r["size"], r.copy) for r in mine}) == len(mine)
            n = int(blocks[s])
            total = sum(min(16, sizes[name] - 16 * int(mixing.permuted(np.array([j % n]), n, mixing.slot_key(17, s, j // n))[0])) for j in range(int(slots[s])))
            assert sum(r.taken for r in mine) == total
    one = [(None, "a b c", "x")] * 500 + [(1, "", "y")] * 300
    same_rows = spark.createDataFrame(one, "doc_id long, text string, source string")
    got = mixing.mix(same_rows).collect()
    assert len(got) == 800 and sum(r.taken for r in got) == pytest.approx(1500, abs=16)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return sorted(found)


def test_pii_base(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a.@-_1234 5+()%é😀\n") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "4111 1111 1111 1111 x@y.zz +1 (523) 555-1055 1.2.3.4", "1.1.1.1 " * 700, "a@" + "b." * 9000 + "c", "4" * 30000, "a" * 50000 + "@", "a@b.c_d@e.f 1.2.3.4.5.6.7.8.9"]
    df = spark.createDataFrame([(i % 300, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    got = pii.find(df, rounds=0).select("doc_id", "base").collect()
    same([(r.doc_id, str([tuple(x) for x in r.base])) for r in got], [(i % 300, str(brute_spans(t))) for i, t in enumerate(texts)])
    assert pii.find(df.limit(0)).count() == 0


def brute_discovered(texts, min_seeds=4, min_confidence=0.8):
    """Of each text the spans that trusted patterns find, by walking the graph in plain Python."""
    shape = re.compile(r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|akia[0-9a-z]{16}|gh[oprsu]_[0-9a-z]{36})$")
    seen = []
    for t, text in enumerate(texts):
        base = brute_spans(text)
        every = [(s, k, e) for s, k, e in base]
        for m in re.finditer(r"(?<![A-Za-z0-9@._/+-])[A-Za-z0-9][A-Za-z0-9@._/+-]*", text):
            token = re.sub(r"[@._/+-]+$", "", m[0])
            if len(token) < 6 or not re.search("[0-9]", m[0]):
                continue
            s, e = m.start(), m.start() + len(token)
            over = [b for b in base if b[0] < e and s < b[2]]
            if not over or (shape.match(token.lower()) and all(s <= b[0] for b in over)):
                every.append((s, None, e))
        for s, k, e in every:
            words = re.sub(r"[\"'(<\[{]+$", "", text[max(0, s - 120) : s]).split()
            after = re.match(r"\S*\s+(\S+)", text[e : e + 60])
            value = text[s:e].lower()
            seed = k if k is not None else 4 if shape.match(value) else None
            patterns = [("2", *words[-2:])] if len(words) > 1 else []
            patterns += [("1", words[-1], after[1])] if words and after else []
            seen.append((t, s, k, e, seed, value, [tuple(x.lower() for x in p) for p in patterns]))
    edges = defaultdict(dict)
    for *_, seed, value, patterns in seen:
        for p in patterns:
            edges[p][value] = min([x for x in (seed, edges[p].get(value)) if x is not None], default=None)
    trusted, grown = {}, True
    while grown:
        now = {}
        for p, values in edges.items():
            for k in range(5):
                own = sum(x == k for x in values.values())
                known = sum(x is not None for x in values.values())
                gained = sum(x is None and any(v in edges[q] and q != p for q, j in trusted if j == k) for v, x in values.items())
                confidence = (own + gained) / (own + gained + known - own + (len(values) - known - gained) / 8 + 1)
                if own and own + gained >= min_seeds and confidence >= min_confidence:
                    now[p, k] = confidence
        grown, trusted = len(now) > len(trusted), now
    found = defaultdict(set)
    for t, s, k, e, seed, _, patterns in seen:
        best = max(((trusted[p, j], -j) for p in patterns for j in range(5) if (p, j) in trusted and seed in (None, j)), default=None)
        if k is None and best:
            found[t].add((s, -best[1], e))
    return [sorted(found[t]) for t in range(len(texts))]


def test_pii_graph_against_brute_force(spark):
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    value = [lambda: f"{rng.randint(1, 99)}.2.3.{rng.randint(1, 99)}", lambda: f"u{rng.randint(1, 40)}@x.org", lambda: f"AB{rng.randint(100000, 100060)}", lambda: f'"{hexes(40)}"', lambda: f"id={rng.randint(1000000, 1000040)}", lambda: f"{hexes(12)}a1."]
    likely = {"badge no": (0, 0, 0, 0, 2), "host at": (0, 0, 2, 4), "token =": (3, 3, 3, 3, 3, 3, 5), "the code": (1, 2, 2, 2, 4, 5), "mail to": (1, 1, 1, 2), "see also": (0, 1, 2, 3, 4, 5)}
    texts = []
    for _ in range(500):
        w = rng.choice(list(likely))
        texts.append(f"so {w} {value[rng.choice(likely[w])]()} {rng.choice(['today', 'now', 'there'])} and {rng.choice('abc')} {value[rng.choice([2, 4])]()} end")
    want = brute_discovered(texts)
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:30]])), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans if x not in r.base] for r in pii.find(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and [got[500 + i] for i in range(30)] == want[:30]
    kinds = Counter(k for w in want for _, k, _ in w)
    assert kinds[4] > 50 and len(kinds) > 1


def test_pii_finds_the_planted_secrets(spark):
    """In the given documents no base pattern fits the 40 digits in quotes after `token =`; all are found, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {(r.doc_id, m.start(), m.end()) for r in docs.collect() for m in re.finditer(r"(?<=\")[0-9a-fA-F]{40}(?=\")", r.text or "")}
    found = {(r.doc_id, x.s, x.e) for r in pii.find(docs).collect() for x in r.spans if x not in r.base}
    assert planted and found == planted


def test_pii_keeps_all_columns(spark):
    rows = [(1, "call +1 (523) 555-1055 now", 3), (None, None, 4), (1, "call +1 (523) 555-1055 now", 3), (2, "", 5), (3, "x" * 200_000 + " a@b.cd", 6)]
    names = ("base", "_key", "_base", "_text", "_row", "found", "spans", "_t")
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    for n in names[1:]:
        df = df.withColumn(n, F.lit(n))
    got = pii.redacted(df)
    assert got.columns == df.columns
    same([(r.doc_id, r.text, r.base, r.spans) for r in got.collect()], [(1, "call [PHONE] now", 3, "spans"), (None, None, 4, "spans"), (1, "call [PHONE] now", 3, "spans"), (2, "", 5, "spans"), (3, "x" * 200_000 + " [EMAIL]", 6, "spans")])
    assert pii.redacted(df.limit(0)).count() == 0


def test_pii_trusts_contexts_up_to_a_share_of_unseen_values(spark):
    """Values of which nothing is known count an eighth: of 100, 60 leave a context 40 / (40 + 60 / 8 + 1), 75 too little."""
    rows = []
    for word, unseen in (("badge", 60), ("locker", 75)):
        rows += [(0, f"then {word} holder {word}no {i}.2.3.{i} today") for i in range(100 - unseen)] + [(i, f"then {word} holder {word}no {word[0]}x{i + 10000000} today") for i in range(unseen)]
    found = pii.find(spark.createDataFrame([(f"{t.split()[1]} {i}", t) for i, t in rows], "doc_id string, text string")).collect()
    more = Counter(r.doc_id.split()[0] for r in found if len(r.spans) > len(r.base))
    assert more == {"badge": 60}


def test_pii_finds_more_by_context(spark):
    rows = [(i, f"text {i} then my badge number is {i}.2.3.{i} today") for i in range(12)] + [(90, "well my badge number is AB12345678 today"), (91, "the AB12345678 elsewhere"), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (len(r.base), [tuple(x) for x in r.spans]) for r in pii.find(df).collect()}
    assert found[90] == (0, [(24, 1, 34)]) and found[91][1] == [] and found[3][0] == 1
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()}[90] == "well my badge number is [IP] today"


def brute_top(vectors, k=5):
    for q, a in vectors:
        if q is not None and q % 50 == 0 and a is not None:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i is not None and i != q and b is not None)
            yield from ((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    raw = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    raw += [(i, raw[0][1]) for i in range(300, 340)] + [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (551, [float("nan")] * 6), (552, [float("inf")] * 6), (None, [1.0] * 6), (7, raw[7][1])]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    sound = [(i, [int(np.floor(256 * x)) for x in v] if v and all(x is not None and np.isfinite(x) for x in v) else None) for i, v in raw]
    want = list(brute_top(sound))
    same(topk.top_k(df, df.filter("vec_id % 50 = 0")).collect(), want)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    same(topk.top_k(df, df.filter("vec_id % 50 = 0")).collect(), want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert len(topk.top_k(df.limit(3), df.limit(1)).collect()) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(queries.ORACLES[name])
    same(got.select(*rel.columns).collect(), rel.fetchall())


def test_pipeline(spark):
    """All stages again in plain Python."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = list(brute_languages([(t, lang) for _, t, lang, _ in rows], [t for _, t, *_ in rows]))
    left = [r for r, (lang, score) in zip(rows, found) if lang != "und" and (score >= 0.3 or score >= 0.05 and sum(map(str.isalpha, r[1])) < 200)]
    roots = brute_components([brute_fingerprint(t) for _, t, *_ in left])
    low = {}
    for i, t, *_ in left:
        low.setdefault(roots[brute_fingerprint(t)], []).append(i)
    kept = [r for r in left if r[0] == min(low[roots[brute_fingerprint(r[1])]])]
    tests = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        passage = decontamination.words_of(text)
        numbers = {w: n for n, w in enumerate(dict.fromkeys([*passage, *sum(tests, [])]))}
        p = np.array([numbers[w] for w in passage])
        return any(w and set(w) & set(passage) and decontamination.align(p, np.array([numbers[x] for x in w]))[0] >= len(w) for w in tests)

    clean = [r for r in kept if not leaks(r[1])]
    assert len(rows) > len(kept) > len(clean)
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]"]
    want = []
    for (i, text, _, source), more in zip(clean, brute_discovered([t for _, t, *_ in clean])):
        out, at = "", 0
        for s, k, e in sorted([*brute_spans(text), *more]):
            if s >= at:
                out += text[at:s] + names[k]
            at = max(at, e)
        want.append((i, source, out + text[at:], len(WORD.findall(out + text[at:]))))
    got = corpus_pipeline.run(spark, sf).collect()
    same([(r.doc_id, r.source, r.text, r["size"]) for r in got], want)
    sizes = Counter()
    for _, source, _, n in want:
        sizes[source] += n
    order = sorted(sizes)
    aims = dict(zip(order, mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
    assert all(abs(taken[s] - aims[s]) <= 0.02 * aims[s] + 48 for s in order)


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs
    for name in ("_row", "_key", "base", "_base", "_kept", "_pred", "lang_pred", "_order", "key", "hash", "copy", "taken"):
        odd = odd.withColumn(name, F.lit(name))
    for some in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, some, str(tmp_path))
            assert name == "mixing" or got.columns == some.columns
            assert got.count() <= some.count() and (name not in ("PII", "mixing") or got.count() == some.count())
    mixed = corpus_pipeline.mixing_stage(spark, odd, "").collect()
    same([(r.doc_id, r.source, r.text) for r in mixed], [(r.doc_id, r.source, r.text) for r in docs.collect()])


def test_pipeline_drops_other_languages(spark):
    """Of languages that were not learned long texts go; short texts of learned ones stay."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    polish = "Wczesnym rankiem nad rzeką unosiła się gęsta mgła, a rybacy powoli przygotowywali swoje łodzie do wypłynięcia. Nikt nie rozmawiał głośno, bo wszyscy wiedzieli, że ryby słyszą każdy dźwięk. Dopiero gdy słońce wzeszło ponad drzewa, ktoś zaczął śpiewać starą pieśń, którą znali jeszcze jego dziadkowie i pradziadkowie z sąsiedniej wsi."
    junk = "qzxvkjwq pzxwvkq jjqxzkv wvqzkxp kqzxjwv " * 12
    more = spark.createDataFrame([(-1, polish, None), (-2, junk, None), (-3, "the", None), (-4, "von der", None), (-5, "", None), (-6, None, None), (-7, "12 34", None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), "").collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {-3, -4}


def test_pipeline_drops_leaking_rows_only(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {item} end"), (None, "clean text of no id"), (None, None), (5, "clean text of a repeated id"), (5, item), (5, None), (6, item), (7, ""), (7, "clean text of a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("x"))
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    same([(r.doc_id, r.text) for r in got.collect()], [r for r in rows if item not in (r[1] or "")])


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(4, one), (4, one.upper()), (4, two), (9, one), (None, one), (None, two), (None, two), (None, three), (None, three), (3, two), (4, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("x"))
    group = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    got = corpus_pipeline.near_dup_stage(spark, docs, "")
    assert got.columns == docs.columns and len({f for _, f in group}) == 4
    same([(r.doc_id, r.text.lower()) for r in got.collect()], [(4, one), (3, two), (None, three), (4, "quite another text")])
