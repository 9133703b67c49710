"""Operators on text against brute force, on hard rows: nulls, empty and long texts, ties, copies, clashing columns."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.llm import chat, common, fingerprints, jaccard, language, mixing, pii, substrings, toxicity
from lograil.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n string, spans string, component_id string, key string"
WORD = r"[^\x20\x09-\x0D]+"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "é", "中"]
    passage = " ".join(rng.choice(words) for _ in range(45))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] += "\n" + passage + "  " + rng.choice(words)
    for i in range(2, n, 9):
        t = texts[i - 1].split()
        t[rng.randrange(len(t))] = "edited"
        texts[i] = " ".join(t)
    texts += [texts[3], texts[3].upper(), "", " \t\n", "a " * 400, "one two", "One TWO", "x" * 50_000, "lorem ipsum " * 3000]
    rows = [(i * 3, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t), 5, "n", "s", "c", "k") for i, t in enumerate(texts)]
    return rows + [(10_000, None, None, None, None, 1, "n", "s", "c", "k"), (None, texts[4], "en", "s1", 1, 1, "n", "s", "c", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, none):
    rows = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, *_ in corpus()), key=lambda r: r[0])
    seen, want = {}, {}
    cut = {i: re.findall(WORD, t) for i, t in rows}
    for i, w in cut.items():
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in cut.items():
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = {-(1 << 63) if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got == want
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("change", [{"HOT": 1}, {"HOT": 1, "HOT_SENT": 0}, {"CHUNK": 40, "SEEN": 3}, {"SHARD_WORDS": 300, "BUCKET": 5, "HOT": 3, "CHUNK": 1}])
def test_substrings_by_other_ways_give_the_same(docs, monkeypatch, change):
    plain = sorted(map(str, substrings.remove_repeats(docs).collect()))
    for name, value in change.items():
        monkeypatch.setattr(substrings, name, value)
    assert sorted(map(str, substrings.remove_repeats(docs.repartition(5)).collect())) == plain


def test_substrings_of_rows_without_a_doc_id_of_their_own(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(30)
    lists = [(None, fresh(5) + passage), (None, fresh(90)), (None, fresh(60) + passage + fresh(9)), (None, fresh(3)), (None, []), (7, fresh(40) + passage), (7, fresh(100)), (7, fresh(25))]
    lists += [(8, fresh(70)), (None, lists[2][1])]
    seen = {}
    for i, w in lists:
        for k in range(len(w) - 19):
            key, at = tuple(w[k : k + 20]), (-(1 << 63) if i is None else i, k)
            seen[key] = min(seen.get(key, at), at)
    want = []
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (-(1 << 63) if i is None else i, k):
                gone[k : k + 20] = [True] * 20
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = substrings.remove_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in lists], "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("seed", range(3))
def test_fm_index_counts(seed):
    rng = np.random.default_rng(seed)
    seqs = [rng.integers(1, 4, rng.integers(3, 40)) for _ in range(30)]
    index = FMIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), 5)
    joined = [tuple(s.tolist()) for s in seqs]
    found = 0
    for who, at, lo, hi in index.matches(seqs):
        for w, a, x, y in zip(who, at, lo, hi):
            gram = joined[w][a : a + 5]
            assert y - x == sum(s[k : k + 5] == gram for s in joined for k in range(len(s) - 4))
            found += 1
    assert found == sum(max(0, len(s) - 4) for s in seqs)


def test_jaccard(docs, none):
    sets = {}
    for i, t, *_ in corpus():
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets if i is not None}
    for a in root:
        for b in root:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: (len(s), root.get(i)) for i, s in sets.items()}
    assert sum(i is not None and c != i for i, (_, c) in got.items()) > 5
    assert jaccard.similar_groups(none).count() == 0


@pytest.mark.parametrize("binary", [False, True])
def test_connected_components(spark, binary):
    from lograil.llm.components import connected_components

    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5), (7, 6), (7, 6)]
    rng.shuffle(pairs)
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    name = (lambda x: x.to_bytes(4, "big")) if binary else (lambda x: x)
    kind = "binary" if binary else "long"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(6)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert {bytes(k) if binary else k: bytes(v) if binary else v for k, v in got.items()} == {name(k): name(v) for k, v in root.items()}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_release_what_each_round_leaves(spark, monkeypatch):
    from lograil.llm import components

    did = []
    for name in ("checkpointed", "release"):
        monkeypatch.setattr(components, name, lambda df, name=name, f=getattr(common, name): did.append(name) or f(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that no partition has all edges
    try:
        assert {r.root for r in components.connected_components(edges).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rounds = did.count("checkpointed") - 1
    assert rounds > 2 and did == ["checkpointed", *["checkpointed", "release"] * (rounds - 1), "checkpointed"]


def brute_components(texts):
    sets = {i: set(jaccard.document_set(t).tolist()) for i, t in texts.items()}
    root, links = {i: i for i in sets}, 0
    for a in root:
        for b in root:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                links += 1
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root, links


@pytest.mark.parametrize(("small", "block", "heavy"), [(12, 2000, 50_000), (0, 7, 50_000), (2, 5, 20), (12, 2000, 5), (0, 1, 50_000)])
def test_jaccard_of_a_large_group(spark, monkeypatch, small, block, heavy):
    # Near copies of one text at all distances round the threshold, of several lengths, and texts that share half of it.
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    base, texts = fresh(120), {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = fresh(1)[0]
        texts[i] = " ".join(w + fresh(rng.choice([0, 0, 10, 30, 50])))
    texts |= {100 + i: " ".join(base[:60] + fresh(60)) for i in range(20)} | {200 + i: " ".join(fresh(rng.randint(1, 9))) for i in range(20)}
    monkeypatch.setattr(jaccard, "FLOOR", 2)
    for name, value in (("SMALL", small), ("BLOCK", block), ("HEAVY", heavy)):
        monkeypatch.setattr(jaccard, name, value)
    want, links = brute_components(texts)
    got = jaccard.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and links > 100 and len(set(want.values())) > 40


def test_jaccard_links_come_from_tasks_by_bytes(spark, monkeypatch):
    # Near copies of one text, each with a word of its own, all under large shingles; few bytes need few tasks.
    words, tasks = [f"w{i}" for i in range(60)], []
    texts = [(k, " ".join([*words[:k], f"own{k}", *words[k + 1 :]])) for k in range(40)]

    def seen(df, f=jaccard.checkpointed):
        out = f(df)
        if out.columns == ["a", "b"]:
            tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(jaccard, "checkpointed", seen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_components(dict(texts))[0]
    assert tasks and max(tasks) < 50


def test_jaccard_recall_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in table.collect()}
    holders, sets = {}, {i: set(jaccard.document_set(t).tolist()) for i, t in texts.items()}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets.items():
        for b in {b for x in s for b in holders[x] if b > a}:
            o = len(s & sets[b])
            if 100 * o >= 75 * (len(s) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(table).collect()} == {i: find(i) for i in root}


def test_jaccard_links_beyond_unlinked_leaders(spark):
    # 1-3 and 1-4 are just below the threshold; 2-3 is above it, and joins what 1 alone can't.
    for seed in range(1000):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10**9)}" for _ in range(200)]

        def edited(count, last=""):
            w = list(base)
            for k in range(count):
                w[10 + 20 * k] = f"e{seed}_{k}"
            return " ".join(w + [last] * bool(last))

        texts = {1: edited(0), 2: edited(3, "z"), 3: edited(6, "z"), 4: edited(6, "y")}
        sets = {i: jaccard.document_set(t) for i, t in texts.items()}
        if min(sets, key=lambda i: jaccard.identity(sets[i])) == 1:
            break
    link = lambda a, b: bool(jaccard.linked(jaccard.overlap(sets[a], sets[b]), len(sets[a]), len(sets[b])))
    assert link(1, 2) and link(3, 4) and link(2, 3) and not link(1, 3) and not link(1, 4)
    got = jaccard.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_tiles_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64)
        for _ in range(6):
            keep = base[rng.random(len(base)) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, rng.integers(0, 20), dtype=np.uint64)))))
    sets = [s for s in sets if len(s)]
    link = lambda a, b: bool(jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])))
    for side in (None, np.arange(len(sets)) % 2):
        root = np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                if link(a, b) and (side is None or side[a] != side[b]):
                    root[root == root[a]] = root[b]
        found = jaccard.tile_links(sets, np.arange(len(sets)), side)
        got = np.arange(len(sets))
        for a, b in found:
            assert link(a, b)
            got[got == got[a]] = got[b]
        assert all((root[a] == root[b]) == (got[a] == got[b]) for a in range(len(sets)) for b in range(a))


def test_fingerprints(docs, none):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(docs, rows_per_bucket=7).collect()}
    assert len(got) == len(rows)
    shingles = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.split())
    errors = []
    for (i, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingles(t), shingles(new)
        if a and b and "中" not in t:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
        assert got[i].fingerprint == "" or len(base64.b64decode(got[i].fingerprint)) == 256
    assert np.mean(errors) < 0.05 and max(errors) < 0.25
    assert got[9].fingerprint == got[180].fingerprint  # equal texts
    assert fingerprints.document_fingerprints(none).count() == 0


def test_fingerprints_of_short_texts():
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    for n in (1, 3, 5, 7, 12):
        sigs = [fingerprints.signature(fresh(n)) for _ in range(120)]
        assert max(fingerprints.likeness(a, b) for a, b in zip(sigs[0::2], sigs[1::2])) < 0.1
        assert all(fingerprints.likeness(s, s) == 1.0 for s in sigs)
    for n in (12, 40, 150):  # half of the shingles shared
        errors = []
        for _ in range(40):
            head = fresh(n)
            a, b = head + " " + fresh(n // 2), head + " " + fresh(n // 2)
            x, y = (set(fingerprints.shingle_set(t.encode()).tolist()) for t in (a, b))
            errors.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - len(x & y) / len(x | y))
        assert abs(np.mean(errors)) < 0.04
    began = time.perf_counter()
    for _ in range(100):
        fingerprints.signature(fresh(3))
    assert time.perf_counter() - began < 0.5  # 5 ms a text


@pytest.mark.parametrize("ids", [[5], [None], [None, None, 3], [7, 7, 7, 7], [-3, 4, 4, None, 9, 2]])
def test_fingerprints_follow_each_other(spark, ids):
    rows = [(i, f"text number {k} of some words", "clash") for k, i in enumerate(ids)]
    got = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"), rows_per_bucket=1).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t, _) in enumerate(order)]
    assert sorted(map(str, ((r.doc_id, r.edited_sha256) for r in got))) == sorted(map(str, want))


def test_personal_data(spark, none):
    text = "é write a.b@c.org, call +1 (366) 555-9807 or 4111 1111 1111 1111 from 10.0.0.1 and 300.1.1.1 password=45bb0d53635bf1b89d"
    rows = [(1, text), (2, None), (3, ""), (None, text), (4, "a@" * 20_000), (5, "1" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df, pii.train(df)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    base = got[1].spans.split(",")[:4]
    assert [s.split(":")[0] for s in base] == ["email", "phone", "card", "ip"] and got[1].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[4].spans == got[5].spans == ""
    assert pii.find_personal_data(none, pii.Model()).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(df, pii.train(df)).collect()}
    assert "[email]" in masked[1] and "a.b@c.org" not in masked[1] and masked[2] is None and masked[3] == ""


def test_personal_data_base_equals_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rng = random.Random(2)
    parts = ["@", "a.b", "..", "1", "12", "255.", "300.", " ", "-", "+", "(", "+1 (234) 555-1234", "4111111111111111", "a@b.c", "1.2.3.4", ".com", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert sorted(pii.base_spans(t)[0]) == sorted((m.start(), m.end(), k) for k, p in plain.items() for m in re.finditer(p, t) if right(k, m.group()))


def test_personal_data_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        number = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"please call {number} today" if i % 2 else f"order no {number} was sent", 5, "mine"))
    rows += [rows[1], rows[1], (None, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int, spans string")
    model = pii.train(df)
    got = pii.find_personal_data(df, model).collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert all(r.n_spans == len([s for s in r.spans.split(",") if s]) for r in got)
    # The words round a number decide, not its form, which is the same everywhere.
    assert np.mean([r.n_spans == r.doc_id % 2 for r in got if r.doc_id is not None]) > 0.95
    masked = pii.mask_personal_data(df, model)
    assert masked.columns == df.columns and masked.where("spans = 'mine'").count() == 402


def test_long_secrets_are_found_whole():
    for n in (8, 256, 257, 5000):
        value = "aB3_" * (n // 4) + "x" * (n % 4)
        text = f'password="{value}" and more'
        at = text.index(value)
        assert (at, at + n, "secret") in pii.weak_spans(text)


def test_mixing(docs, none):
    rows = mixing.mix_to_weights(docs).collect()
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert len(rows) == len(corpus()) and abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    again = sorted((r.doc_id or -1, r.taken) for r in mixing.mix_to_weights(docs).collect())
    assert again == sorted((r.doc_id or -1, r.taken) for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_to_weights(none).count() == 0


def test_chat(spark):
    rng = random.Random(3)
    turns = []
    for conv in range(12):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", "as<\nsistant", None])
            turns.append((conv, t, role, None if rng.random() < 0.1 else " ".join(rng.choice(["a", "\\l", "<|end|>", "<|turn|>x", "[INST]", "\\", "é\n", "<", "\\b"]) for _ in range(rng.randint(0, 70))), "x"))
    turns.append((3, 0, "user", "tie", "x"))
    turns += [(None, 1, "user", "no id", "x"), (None, 2, "assistant", "none", "x"), (50, 1, "user", "same", "x"), (50, 1, "user", "same", "x")]
    turns += [(51, 0, "system", "s " * 400, "x"), (51, 1, "assistant", "word " * 20_000, "x"), (51, 2, "user", "b", "x"), (51, 3, "assistant", "a " * 100, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append(t)
    for conv, rows in by.items():
        rows.sort(key=lambda t: (t[1], t[2] or "", t[3] or ""))
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in rows)
        said = "".join(t[3] or "" for t in rows if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    kept = windows.where(F.col("tokens") <= chat.BUDGET).count()
    assert windows.where(F.col("window") > 1).count() > 5 and kept > 5
    for r in windows.collect():  # over the budget only for one own turn, and no history with it
        own = [s for s in r.formatted.split(chat.END) if s.startswith(chat.TURN)]
        again = [s for s in r.formatted.split(chat.END) if s.startswith(chat.AGAIN)]
        assert r.tokens <= chat.BUDGET or len(own) == 1 and all(s.startswith(chat.AGAIN + "system") for s in again)
    assert windows.where((F.col("window") > 1) & (F.col("conv_id") % 2 == 1) & (F.col("conv_id") < 12) & ~F.col("formatted").contains(chat.AGAIN + "system")).count() == 0
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + (["idiotic"] * (1 + i % 3) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "keep"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (4, None), (99_999, 1), (0, 1)]
    df = spark.createDataFrame([*rows, (2000, None, "x"), (2001, "", "x"), (None, "idiotic", "x")], "doc_id long, text string, toxic string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [i for i in range(900) if i % 2]
    assert np.mean([got[i].toxic == (i % 6 == 0) for i in held]) > 0.99
    assert not got[2000].toxic and not got[2001].toxic and got[None].toxic
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in got.values()) and list(model.thresholds) == sorted(model.thresholds)
    assert not any(r.toxic for r in toxicity.score_toxicity(df, toxicity.Model()).collect())
    assert toxicity.score_toxicity(none, model).count() == 0


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(400)]
    true = np.array([2.0, -2.0, 1.0, 0.0, 0.0, 3.0])
    s = np.array([true[r].sum() for r in rows]) + rng.logistic(size=400)
    y = np.digitize(s, [0.0, 2.0, 4.0])
    w, theta = toxicity.fit_ordinal(rows, y, 6, 4)
    assert np.corrcoef(w, true)[0, 1] > 0.95 and np.abs(theta - [0.0, 2.0, 4.0]).max() < 1.0


def test_ordinal_likelihood_has_no_better_neighbour():
    # The fit against the plain likelihood, a row and a grade at a time.
    import math

    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(4) < 0.4) for _ in range(300)]
    s = np.array([np.array([1.5, -1.0, 2.0, 0.5])[r].sum() for r in rows]) + rng.logistic(size=300)
    y = np.digitize(s, [0.5, 2.0, 3.0])

    def nll(p):
        total = 0.0
        for r, grade in zip(rows, y):
            score = sum(p[j] for j in r)
            upto = [0.0, *(1 / (1 + math.exp(score - t)) for t in p[4:]), 1.0]
            total -= math.log(upto[grade + 1] - upto[grade])
        return total

    w, theta = toxicity.fit_ordinal(rows, y, 4, 4, steps=3000, l2=0.0)
    at = np.concatenate([w, theta])
    best = nll(at)
    for i in range(7):
        for step in (-0.1, 0.1, -0.02, 0.02):
            near = at.copy()
            near[i] += step
            assert nll(near) > best - 5e-3
    model = toxicity.Model({}, w, theta)
    assert np.allclose(-np.log(model.grades(np.array([w[r].sum() for r in rows]))[np.arange(300), y]).sum(), best)


def test_toxic_grades_come_from_other_texts_and_columns_stay(spark):
    words = [f"word{i}" for i in range(100)]
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        bad = ["nasty", "vile", "rotten"][: 1 + i % 3] if i % 3 == 0 or i % 5 == 0 else []
        rows.append((i, " ".join(rng.choices(words, k=30) + bad), "t", 1.5))
    rows.append((2000, "nasty " * 100_000 + "vile rotten", "t", 0.0))  # a very long text, read to its end
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, _t string, grade double")
    labels = spark.createDataFrame([(i, int("nasty" in t)) for i, t, *_ in rows[:1500]], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    assert got.columns == ["doc_id", "text", "_t", "grade", "expected_severity", "p_toxic", "toxic"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[0]) == 2 and by[0][0] == by[0][1] and by[2000][0].toxic
    severity = lambda k: np.mean([by[i][0].expected_severity for i, t, *_ in rows[:1500] if sum(w in t for w in ("nasty", "vile", "rotten")) == k])
    assert severity(0) < 0.1 < severity(1) < severity(2) < severity(3)


def test_language(spark, sf_dir, none):
    counts = language.Counter({"theation": 5, "the": 9, "straße": 2, "a": 1})
    p = np.stack([language.fit_pieces(counts), language.fit_pieces(language.Counter({"autre": 3, "le": 9}))], axis=1)
    words = ["theation", "straße", "le", "x"]
    with np.errstate(divide="ignore"):
        assert np.allclose(language.forward(words, p), [language.forward_long(w, np.log(p)) for w in words])
    v = language.pieces()

    def total(s):  # over all segmentations, the plain way
        if not s:
            return 1.0
        return sum(p[v.number.get(s[:k], v.letter if k == 1 else v.none), 0] * total(s[k:]) for k in range(1, len(s) + 1))

    assert np.isclose(np.log(total("▁straße")), language.forward(["straße"], p)[0, 0])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(90_000, None, "en"), (90_001, "123 !!", None), (None, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = language.identify_languages(table.unionByName(extra), language.train(table)).join(table, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.9 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[90_000].lang_pred == by[90_001].lang_pred == "und" and by[90_000].score == 0 and by[None].lang_pred != "und"
    assert language.train(none).languages == []


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i, "the cat and the dog " * 3, "en", 1.0) for i in range(0, 300)] + [(i, "le chat et la souris " * 3, "fr", 1.0) for i in range(300, 600)]
    rows += [(3, "le chat et la souris", "en", 1.0), (3, "le chat et la souris", "en", 1.0), (3, "the dog", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify_languages(df, language.train(df)).collect()
    assert len(got) == len(rows) and sorted(r.lang_pred for r in got if r.doc_id == 3) == ["en", "en", "fr", "fr"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 3 and r.lang_pred == "fr"}) == 1


def test_language_learns_from_long_runs_and_starves_none(spark):
    flat = language.fit_pieces(language.Counter())
    assert not np.allclose(language.fit_pieces(language.Counter({"the" * 60: 5})), flat)
    # Of one language, many rows share a doc_id that is chosen; the other has few rows, which must all be learned.
    rows = [(None, f"{'la ' * 5}{'abcdefghij'[i % 10]}", "aa") for i in range(5000)] + [(None, "zebra quartz", "zz")] * 3
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    assert model.languages == ["aa", "zz"]


def test_mixing_by_shuffled_joins(docs, monkeypatch):
    plain = sorted(map(str, mixing.mix_to_weights(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_to_weights(docs).collect())) == plain


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def stage_cases():
    """Rows with nulls, empty and very long texts, ties and repeated rows, and their rows of labels."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    base = fresh(80)
    texts = [(1, base), (2, base), (5, base), (5, fresh(60)), (5, base + " more"), (7, base.upper()), (7, base.upper()), (8, fresh(40)), (8, fresh(40)), (9, "x " * 60_000)]
    texts += [(10, ""), (11, " \n"), (12, None), (None, base), (None, None), (None, "mail a.b@example.com"), (13, "y" * 200_000), (14, base), (14, base)]
    rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    return rows


@pytest.mark.parametrize("number", range(5))
def test_stages_on_hard_rows(spark, sf_dir, number):
    import corpus_pipeline as cp

    rows = stage_cases()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], DOCUMENT + ", size string")
    name, stage = cp.STAGES[number]
    got = stage(spark, docs, sf_dir).collect()
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    key = lambda r: str(tuple(r)[:2])
    if name == "toxicity":  # nothing here is toxic
        assert sorted(map(key, got)) == sorted(map(key, rows))
    elif name == "near_duplicates":
        # One of the linked group stays, that of the least doc_id; a row of doc_id 5 without links stays; repeated rows of 7 and 14 go with the group.
        linked = {(i, t) for i, t, *_ in rows if i is not None and t and t.lower().startswith(rows[0][1].lower()[:200])}
        want = [(i, t) for i, t, *_ in rows if (i, t) not in linked] + [(1, rows[0][1])]
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
        alone = spark.createDataFrame([rows[3], rows[3], rows[3]], DOCUMENT)
        assert stage(spark, alone, sf_dir).count() == 1  # of rows equal in doc_id and text one stays
    elif name == "personal_data":
        assert len(got) == len(rows) and sum(r.text == "mail [email]" for r in got) == 1 and sum(r.text is None for r in got) == 2
    elif name == "mixing":
        assert all(r.text is not None or r.n_chars is None for r in got) and {key(r) for r in got} <= {key(r) for r in rows}
    if name == "encoding":
        assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got) and sum(r.n_tokens == 0 for r in got) == 3
    else:
        assert got[0].__fields__ == cp.COLUMNS


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == cp.COLUMNS
        docs = cp.checkpointed(docs)
        assert docs.count() > 0
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_release_gives_freed_memory_of_the_c_library_back(spark):
    assert common.trim_native_heap(spark.sparkContext)


def test_near_duplicates_release_what_components_leave(spark, monkeypatch):
    did = []
    for name in ("checkpointed", "release", "connected_components"):
        monkeypatch.setattr(jaccard, name, lambda df, name=name, f=getattr(jaccard, name): did.append(name) or f(df))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} x{i}") for i in range(5)], "doc_id long, text string")
    assert jaccard.drop_near_duplicates(docs).count() == 1
    assert did.count("connected_components") >= 2
    assert all(after == "release" for name, after in zip(did, did[1:]) if name == "connected_components")
