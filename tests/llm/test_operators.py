"""Small tables with nulls, empty and repeated rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from echoplot.llm import decontaminate, lm_scoring, mixing, neardup, quality_rules, sharding, substring_dedup, token_counts, token_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string"


def texts(seed=0, n=40):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocabulary, k))
    out = [make(int(rng.integers(1, 120))) for _ in range(n)]
    base = out[0] = make(100)
    out += [base, base, base.replace(" ", "\n", 2), base + " tail", None, "", " \n", "x", make(3000), out[3] + "\n" + out[3], out[4] + " " + base[:200]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None][i % 3] if i % 4 else "a", 0, "clash") for i, t in enumerate(texts())]
    rows += [(None, "no id here at all", "en", "b", 0, "clash"), rows[2]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_repeated_strings(docs, empty):
    got = {r.doc_id: r for r in substring_dedup.repeated(docs).collect()}
    seen, rows = {}, sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").fillna({"text": ""}).collect())
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), gone.sum(), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert substring_dedup.repeated(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = neardup.near_duplicates(docs, k=4).collect()
    sets = {}
    for r in docs.collect():
        w = WORD.findall(lower(r.text or ""))
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id == root(r.doc_id))
    assert len(got) == docs.count() and neardup.near_duplicates(empty).count() == 0
    kept = neardup.one_of_each(docs, k=4)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() <= 1


def test_near_duplicates_of_an_id_on_two_texts(spark):
    rng = np.random.default_rng(11)
    make = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80))
    # for each id from 0 to 9: two unlike texts, of which one or the other has a near copy under another id
    rows, alone = [], {}
    for i in range(10):
        one, two = make(), make()
        rows += [(i, one), (i, two), (100 + i, (one if i % 2 else two) + " tail"), (i, one)]
        alone[i] = (one, two)
    rows += [(200, alone[0][0] + " end"), (201, make()), (202, None), (202, ""), (None, "no id"), (50, make()), (50, rows[4][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, k=4).collect()}
    want = {(i, i, True) for i in range(10)} | {(100 + i, i, False) for i in range(10)} | {(200, 0, False), (201, 201, True), (202, 202, True), (None, None, True), (50, 1, False)}
    assert got == want
    # each text by itself: no unlike text goes, one of each near copies and equal rows stays
    kept = sorted((r.doc_id, r.text) for r in neardup.one_of_each(df, k=4).where("doc_id is not null and doc_id <> 202").collect())
    assert kept == sorted([(i, t) for i, x in alone.items() for t in x] + [rows[41], rows[45]])
    assert neardup.one_of_each(df, k=4).where("doc_id is null or doc_id = 202").count() == 2


def test_near_duplicates_in_many_blocks(spark):
    base = texts(5)[0].split()
    rows = []
    for i in range(60):
        w = list(base)
        w[i % len(w)] = f"new{i}"
        w[(7 * i) % len(w)] = f"other{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    many = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, block_bytes=8000).collect()}
    assert one == many


def test_decontamination(spark, docs, empty):
    items = [(1, texts()[0][:180]), (2, "short"), (None, "a null id of an item that no document has at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.matches(docs, bench).collect()}
    want = {r.doc_id for r in docs.collect() if r.text and items[0][1] in " ".join(r.text.split())}
    assert {i for i, x in got.items() if x == [1]} == want and len(want) >= 4
    edited = items[0][1].replace("a", "z", 5)
    one = spark.createDataFrame([(7, "before " + edited + " after"), (8, None)], "doc_id long, text string")
    assert {r.doc_id: len(r["items"]) for r in decontaminate.matches(one, bench).collect()} == {7: 1, 8: 0}
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_finds_excerpts_at_every_offset():
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    make = lambda k: "".join(rng.choice(letters, k)).replace(" ", "_")
    items = [(1, make(394)), (2, make(230)), (3, make(161)), (4, make(120)), (5, make(60))]
    index = decontaminate.Index(items)

    def found(texts):
        raw = "".join(texts).encode()
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = {}
        for r, item, _, d in decontaminate.find(index, np.frombuffer(raw, np.uint8), off):
            got.setdefault(r, []).append((item, d))
        return got

    for least in (80, 81, 120, 140, 160):
        cuts = [(i, t[k : k + least]) for i, t in items for k in range(len(t) - least + 1)]
        got = found([make(50) + c + make(70) for _, c in cuts])
        assert [[i for i, _ in got.get(n, [])] for n in range(len(cuts))] == [[i] for i, _ in cuts]
        assert least != 80 or all(got[n][0][1] == 0 for n in range(len(cuts)))
    # up to six edits in 80 bytes, of each kind
    cuts = []
    for i, t in items[:3]:
        for k in range(0, len(t) - 79, 3):
            c = t[k : k + 80]
            for n in np.sort(rng.choice(np.arange(2, 78), 6, replace=False))[::-1]:
                c = [c[:n] + "#" + c[n + 1 :], c[:n] + c[n + 1 :], c[:n] + "#" + c[n:]][int(rng.integers(3))]
            cuts.append((i, c))
    got = found([c if n % 5 == 0 else make(40) + c + make(200) for n, (_, c) in enumerate(cuts)])
    assert [[i for i, _ in got.get(n, [])] for n in range(len(cuts))] == [[i] for i, _ in cuts]
    # no more than that: half a passage, or the passage's letters in another order
    assert not found([make(50) + items[0][1][k : k + 50] + make(50) for k in range(0, 300, 7)] + [items[0][1][200:280][::-1]])
    assert not decontaminate.find(decontaminate.Index([]), np.zeros(100, np.uint8), np.array([0, 100]))


def test_sharding(docs, empty):
    n = docs.count()
    assert sorted(sharding.feistel(np.arange(1000), 1000)) == list(range(1000))
    got = sharding.shard(docs, 7).collect()
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and len(got) == n
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    for r in got:
        assert (r.shard, r.slot) == tuple(int(x[0]) for x in sharding.locate(r.row_number, n, 7))
    assert sharding.shard(empty, 7).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=8).collect()
    sizes = Counter()
    for r in got:
        assert r.taken <= 3 * r.size
        sizes[r.source] += r.size
    for s in sizes:
        target = next(r.target for r in got if r.source == s)
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - target) <= 16 and target <= 3 * sizes[s] + 1e-6
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=8).collect()))
    assert mixing.mix(empty).count() == 0
    words = mixing.mixed_texts(docs, block=8).collect()
    assert sum(len(WORD.findall(r.text)) for r in words) == sum(r.taken for r in got)


def test_repetition(docs, empty):
    for r, t in ((r, t) for r in quality_rules.repetition(docs).collect() for t in [next((x.text for x in docs.where("doc_id is not null").collect() if x.doc_id == r.doc_id), None)] if r.doc_id in (0, 42, 45, 46, 50)):
        w = WORD.findall(t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count = Counter(grams)
        inside = {j + d for j, g in enumerate(grams) if count[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
    assert quality_rules.repetition(empty).count() == 0


def test_language_model(docs, empty):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    rows = [(r.doc_id, WORD.findall(lower(r.text or ""))) for r in docs.collect()]
    count = Counter()
    for i, w in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update([*w, None])
    total, kinds = sum(count.values()), len(count)
    for i, w in rows:
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in [*w, None])
        assert got[i].base_score == pytest.approx(base) and got[i].train_tokens == total and got[i].n_tokens == len(w) + 1
    assert lm_scoring.score(empty).count() == 0
    assert all(r.score <= 0 for r in got.values())


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.tokenizer_path())
    table = token_ids.write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect() if r.doc_id is not None}
    start = 0
    for r in sorted(token_ids.digests(table).collect(), key=lambda r: r.doc_id):
        ids = np.array([*want[r.doc_id], 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_ids.digests(token_ids.write_tokens(empty)).count() == 0
    for rule in token_counts.RULES:
        for r in token_counts.token_counts(docs, rule).collect():
            if r.doc_id is not None:
                assert r.n_tokens == len(want[r.doc_id]) and sum(r.section_tokens) == pytest.approx(r.n_tokens)
