"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rolesift.llm import (
    bloom, decontamination, exact_dedup, fm_index, licenses, lm_scoring, packing, simhash, toxicity,
    training_order, url_filter, warc,
)
from rolesift.llm.components import components

SF = "/root/testdata/sf0.001"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", key long, found string, score double, bucket string, n_tokens string, `a.b` int"
SPACE = re.compile("[\x20\x09-\x0D]+")


def docs_of(spark, rows, extra=False):
    """Documents from (id, text); with `extra`, also columns whose names operators use themselves."""
    full = [(i, t, None, None, None, *((1, "x", 0.5, "b", "n", 2) if extra else ())) for i, t in rows]
    return spark.createDataFrame(full, DOC + (EXTRA if extra else ""))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


MIXED = [
    (1, "The quick  brown\tfox jumps"), (2, "The quick brown fox jumps"), (2, "The quick brown fox jumps"),
    (None, "The quick brown fox jumps"), (3, None), (4, ""), (5, " "), (6, "é" * 50 + " ÀB 0x"),
    (7, "word " * 30_000), (8, "word " * 30_000), (None, None), (9, "a b"), (10, "one\ntwo\nthree\nfour"),
]


# ---- Exact duplicates ----


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("bucket_keys,max_depth", [(4096, 20), (1, 6), (2, 1)])
def test_exact_groups(spark, bucket_keys, max_depth):
    got = exact_dedup.exact_groups(docs_of(spark, MIXED, True), bucket_keys=bucket_keys, max_depth=max_depth)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_exact(MIXED)


def test_exact_groups_with_a_hot_text_and_empty(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    assert Counter(map(tuple, exact_dedup.exact_groups(docs_of(spark, rows)).collect())) == brute_exact(rows)
    assert exact_dedup.exact_groups(docs_of(spark, [])).collect() == []


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    directory = exact_dedup.directory_of(keys, bucket_keys=300, max_depth=12)
    slots = directory.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(1 << directory.depth))
    held = Counter()
    of_slot = {r.slot: (r.bucket, r.depth) for r in slots}
    for r in keys.collect():
        held[of_slot[(r.key % (1 << 64)) >> (64 - directory.depth)]] += 1
    assert max(held.values()) <= 300
    parents = Counter()
    for (bucket, depth), n in held.items():
        parents[(bucket >> (12 - depth + 1), depth - 1)] += n
    twins = Counter((b >> (12 - d + 1), d - 1) for b, d in held)
    assert all(parents[p] > 300 for p, n in twins.items() if n == 2)


# ---- SimHash ----


def brute_fingerprint(text, size=3):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits=3):
    left, roots = set(values), {}
    while left:
        start = min(left)
        reached, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for other in [v for v in left if v not in reached and (at ^ v).bit_count() <= max_bits]:
                reached.add(other)
                todo.append(other)
        left -= reached
        roots |= dict.fromkeys(reached, start)
    return roots


def test_near_groups(spark):
    rows = MIXED + [(100 + i, " ".join(f"w{k}" for k in range(400) if k != i * 7)) for i in range(40)]
    got = simhash.near_groups(docs_of(spark, rows, True)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert simhash.near_groups(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("group_rows", [4, 2048])
def test_links_connect_what_is_linked(spark, group_rows):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    values = {c ^ sum(1 << int(b) for b in rng.integers(0, 64, n % 5)) for c in centres for n in range(60)}
    values |= {(1 << 64) - 1, 0, 7, 63}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), group_rows=group_rows)
    assert all((r.a ^ r.b).bit_count() <= 3 or ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in edges.collect())
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    want = brute_components(values)
    groups = lambda m: {frozenset(k for k in values if m.get(k, k) == r) for r in {m.get(k, k) for k in values}}
    assert groups(found) == groups(want)


def test_block_masks_cover_every_choice_of_bits():
    masks = simhash.block_masks(6, 3)
    rng = np.random.default_rng(1)
    for _ in range(200):
        flips = sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))
        assert any(flips & m == 0 for m in masks)


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {1}


# ---- Decontamination ----


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(1, 4, 400), [0], np.tile([1, 2, 3], 50), [0], [2], [0]]).astype(np.int64)
    index = fm_index.FMIndex(text, 2)
    for size in (1, 2, 5):
        phrases = np.array([rng.integers(1, 4, size) for _ in range(40)])
        which, low, high = index.search(phrases)
        found = dict(zip(which.tolist(), zip(low.tolist(), high.tolist())))
        for k, phrase in enumerate(phrases):
            at = [i for i in range(len(text) - size + 1) if (text[i : i + size] == phrase).all()]
            rows = np.arange(*found.get(k, (0, 0)))
            assert sorted(index.locate(rows).tolist()) == at


def brute_hits(text, items, window=13):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, names = set(), set()
    for name, body in items:
        b = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        size = min(window, len(b))
        for s in {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else ():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == s:
                    hit.update(range(i, i + size))
                    names |= {str(name)} - {"None"}
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, 0 < len(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("shard_words,block_bytes", [(1_000_000, 1 << 24), (50, 40)])
def test_contamination(spark, shard_words, block_bytes):
    long_item = " ".join(f"q{k}" for k in range(20))
    items = [(1, long_item), (2, "Short One"), (3, None), (4, "..."), (None, "lonely item here"), (2, "Short One"),
             (10, "aa aa"), (11, " ".join(f"q{k}" for k in range(5, 18)))]
    rows = MIXED + [
        (20, "x " + long_item.upper() + " y"), (21, "short, one! short one short"), (22, "aa aa aa aa"),
        (23, "a lonely item here"), (24, long_item[:30]), (25, ("filler " * 300) + long_item), (26, "q5 q6"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination_digest(
        docs_of(spark, rows, True), bench, shard_words=shard_words, block_bytes=block_bytes
    ).collect()
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(r.n_items > 1 for r in got)


def test_contamination_of_empty_tables_and_spans(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontamination.contamination_digest(docs_of(spark, [(1, "a b")]), none).collect()] == [(2, 0, 0)]
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontamination.contamination_digest(docs_of(spark, []), bench).collect() == []
    found = decontamination.find_contamination(docs_of(spark, [(1, "a b c b c x b c")], True), bench)
    assert found.columns == [*[c for c in docs_of(spark, [], True).columns if c != "found"], "found"]
    assert [tuple(s) for s in found.first().found.spans] == [(1, 5), (6, 8)]


def test_words_over_slice_ends(monkeypatch):
    from rolesift.llm import words as w

    text = b"Some words " * 50 + b"x" * 100 + b" end"
    whole = [x for s in w.word_slices(text, w.ALNUM) for x in s]
    monkeypatch.setattr(w, "SLICE_BYTES", 16)
    assert [x for s in w.word_slices(text, w.ALNUM) for x in s] == whole == text.lower().split()
    assert simhash.fingerprint(text) == brute_fingerprint(text.decode())


# ---- Language-model scores ----


@pytest.mark.parametrize("settings", [
    lm_scoring.Settings(), lm_scoring.Settings(frequent=20, broadcast_bytes=2048, page_blocks=8, bits_per_entry=40),
])
def test_lm_scores(spark, settings):
    rows = MIXED + [(50 + k, " ".join(f"w{k * j % 17}" for j in range(30))) for k in range(60)]
    got = lm_scoring.lm_digest(docs_of(spark, rows, True), settings).collect()
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    ends = {i: None for i, _ in rows}
    assert len(ends) and len(got) == len(rows)
    counts = Counter(w for i, t in rows if learned(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, not learned(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 4))] += 1
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_lm_keeps_ngrams_seen_once(spark):
    texts = ["a b c", "a b d", "e f"]
    docs = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    model = lm_scoring.train(docs)
    want = Counter()
    for t in texts:
        tokens = [None, *t.split(), None]
        for k in (1, 2, 3):
            want.update((k, tuple(tokens[i - k + 1 : i + 1])) for i in range(max(1, k - 1), len(tokens)))
    assert Counter(tuple(r) for r in model.ngrams.select("order", "n").collect()) == Counter((k[0], n) for k, n in want.items())


def test_lm_parts_of_the_filter_give_the_same_scores(spark):
    rows = [(k, " ".join(f"w{k * j % 23}" for j in range(40))) for k in range(80)]
    tables = [
        {r.doc_id: r.score for r in lm_scoring.lm_digest(docs_of(spark, rows), s).collect()}
        for s in (lm_scoring.Settings(order=3, bits_per_entry=64),
                  lm_scoring.Settings(order=3, bits_per_entry=64, broadcast_bytes=1024, page_blocks=4))
    ]
    assert tables[0].keys() == tables[1].keys()
    assert all(abs(tables[0][k] - tables[1][k]) <= 0.05 * abs(tables[0][k]) for k in tables[0])


def test_lm_without_anything_to_learn(spark):
    assert lm_scoring.lm_digest(docs_of(spark, [])).collect() == []
    rows = lm_scoring.lm_digest(docs_of(spark, [(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_bloom_filter_has_what_was_added():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    blocks = 80
    words_ = np.zeros(blocks * bloom.BLOCK_BITS // 64, dtype=np.uint64)
    at = bloom.block_of(keys, blocks)
    bloom.add(words_, at, keys, 1)
    assert bloom.has(words_, at, keys, 1).all()
    assert bloom.has(words_, at, keys, 2).mean() < 0.2


def test_levels_stand_for_their_counts():
    counts = np.arange(1, 5000)
    middle = lm_scoring.level_counts(1.5)[lm_scoring.levels_of(counts, 1.5)]
    assert (middle[:3] == counts[:3]).all() and (np.abs(middle - counts) / counts < 0.25).all()


# ---- Toxicity ----


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(2)
    bad = [i for i in range(1500) if rng.random() < 0.12]
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 500) + (" grobian lump grobian lump" if i in set(bad) else ""))
            for i in range(1500)] + [(None, None), (5000, ""), (5001, None)]
    labels = spark.createDataFrame(
        [(i, None, int(i in set(bad))) for i in range(1500) if i % 2 == 0] + [(None, None, 1), (4, None, None)],
        "doc_id long, quality int, toxic int",
    )
    got = toxicity.toxicity_digest(docs_of(spark, rows, True), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.doc_id in set(bad)) for r in held)
    assert len({r.score for r in got if r.doc_id in (None, 5000, 5001)}) == 1


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_digest(docs_of(spark, [(1, "a"), (2, None)]), none).collect()
    assert len(rows) == 2 and len({r.score for r in rows}) == 1
    assert toxicity.toxicity_digest(docs_of(spark, []), none).collect() == []


@pytest.mark.parametrize("corpus, labelled", [
    (0.2, lambda i, bad: i % 2 == 0 and (not bad or i % 4 == 0)),  # more toxic texts than the labels' share
    (0.1, lambda i, bad: bad or i % 8 == 0),  # labels that oversample toxic texts
    (0.15, lambda i, bad: bad and i % 2 == 0),  # confirmed positives only
])
def test_toxicity_is_no_quota_of_the_label_share(spark, corpus, labelled):
    rng = np.random.default_rng(5)
    bad = rng.random(1500) < corpus
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 500) + (" grobian lump grobian lump" if bad[i] else ""))
            for i in range(1500)]
    labels = spark.createDataFrame(
        [(i, int(bad[i])) for i in range(1500) if labelled(i, bad[i])], "doc_id long, toxic int"
    )
    got = [r for r in toxicity.toxicity_digest(docs_of(spark, rows), labels).collect() if r.held_out]
    missed = sum(bad[r.doc_id] and not r.predicted for r in got)
    wrong = sum(not bad[r.doc_id] and r.predicted for r in got)
    assert missed <= 0.02 * len(got) and wrong <= 0.02 * len(got)


def test_toxicity_features_are_counted_over_all_texts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) % 300) + (" grobian" if i % 9 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(900)], "doc_id long, toxic int")
    few, all_ = (
        toxicity.train(docs_of(spark, rows), labels, toxicity.not_held_out,
                       toxicity.Training(max_positive=20, max_unlabelled=n, features=40, epochs=2))
        for n in (60, 20_000)
    )
    assert few.hashes.tolist() == all_.hashes.tolist() and len(all_.hashes) == 40


def test_non_negative_risk_does_not_fit_the_positives_alone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 0.3
    x[y, 0] += 4
    w, b = toxicity.fit_nnpu(x[y][:60], x, 0.3, toxicity.Training(epochs=60), 0)
    assert ((x @ w + b >= 0) == y).mean() > 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    scored = toxicity.toxicity_digest(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = scored.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    order = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert order > 0.93 and sum(b >= 0.5 for b in bad) > 0.7 * len(bad) and sum(g >= 0.5 for g in good) < 0.03 * len(good)


# ---- WARC ----

PAGES = [
    (1, "http://a.net/x?y=1#z", "<p>é</p>"), (2, "http://b.net/\r\nX-Y: 1", "<p>é</p>"), (3, None, None), (4, "", ""),
    (None, "http://c", "<p>é</p>"), (None, None, "only null ids"), (None, None, "only null ids"),
    (5, "http://d", "x" * 3_000_000), (6, "http://ü.de/%20", "a\r\n\r\nb"), (6, "http://ü.de/%20", "a\r\n\r\nb"),
]


@pytest.mark.parametrize("min_bytes", [0, 9])
def test_warc_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    folder, index = warc.write_bundles(pages, min_bytes=min_bytes, frame_bytes=4096, bundle_bytes=1000)
    got = warc.read_bundles(folder, index).collect()
    want = []
    for i, url, html in PAGES:
        payload = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == payload and j is not None]
        first = min(same, default=None) if len(payload) >= min_bytes else None
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, url, None if revisit else payload, len(payload), digest, "revisit" if revisit else "response",
                     first if revisit else None))
    plain = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    assert Counter(map(plain, got)) == Counter(want)
    one = warc.read_bundles(folder, index.filter("page_id = 5")).collect()
    assert [len(r.payload) for r in one] == [3_000_000]


def test_warc_files_are_plain_zstandard(spark):
    import zstandard
    from pyarrow import fs

    pages = spark.createDataFrame([(k, "http://x", "y" * 500 + str(k)) for k in range(50)], "page_id long, url string, html string")
    folder, index = warc.write_bundles(pages.coalesce(1), frame_bytes=2000)
    files, root = fs.FileSystem.from_uri(folder)
    name = index.first().bundle
    with files.open_input_file(f"{root}/{name}") as file:
        table = warc.read_seek_table(file)
        file.seek(0)
        whole = file.read()
    with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as reader:
        content = reader.read()
    assert len(table) > 5 and sum(t[2] for t in table) == len(content) and content.count(b"WARC/1.1\r\n") == 50


def test_warc_of_no_pages(spark):
    assert warc.archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- Packing ----


def test_pack_is_whole_and_fits(spark):
    rows = MIXED + [(1000 + k, "w " * (k * 37 % 9000)) for k in range(300)]
    got = packing.pack(docs_of(spark, rows, True), shard_pieces=150).collect()
    wanted = Counter()
    for i, t in rows:
        wanted[i] += len(words(t)) + 1
    packed = Counter()
    for r in got:
        packed[r.doc_id] += r.n_tokens
    assert packed == wanted
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_length for r in pieces} == {next(n for n in packing.LENGTHS if n >= at)}
    assert len({b[0].bin_length for b in bins.values()}) > 1
    assert packing.pack(docs_of(spark, [])).collect() == []


def brute_best_fit(sizes, lengths, cost):
    """Bins as (content, length), by looking at every open bin."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[1] - b[0] >= size]
        if fit:
            min(fit, key=lambda b: b[1] - b[0])[0] += size
        else:
            bins.append([size, min((n for n in lengths if n >= size), key=lambda n: (cost(n) / n, -n))])
    return sorted((filled, min((n for n in lengths if n >= filled), key=lambda n: (cost(n), n))) for filled, _ in bins)


def test_packer_is_best_fit():
    rng = np.random.default_rng(4)
    for cost in (packing.bin_cost, lambda n: n, lambda n: 100 + n):
        sizes = [int(x) for x in rng.integers(1, 65, 300)]
        packer = packing.Packer((16, 32, 64), cost)
        for size in sorted(sizes, reverse=True):
            packer.place(size)
        assert sorted(zip(packer.filled, packer.final_lengths())) == brute_best_fit(sizes, (16, 32, 64), cost)


# ---- Training order ----


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    order, other = training_order.Feistel(size, "a"), training_order.Feistel(size, "b")
    slots = order.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.index(slots) == np.arange(size)).all()
    assert size < 100 or (slots != other.slot(np.arange(size))).any()


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")
def test_shards_hold_all_tokens_in_order(spark):
    vocabulary = training_order.Vocabulary.from_file(RANKS)
    rows = MIXED + [(300 + k, f"text number {k} " * k) for k in range(40)]
    docs = docs_of(spark, rows, True).repartition(3)
    made = training_order.materialise(docs, vocabulary, width=64, shard_sequences=50)
    index = sorted(made.rows.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in index] == list(range(made.sequences))
    assert sorted(r.slot for r in index) == list(range(made.sequences))
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 128 for r in index)
    in_order = made.read(0, made.sequences + 5)
    assert all(zlib.crc32(in_order[r.slot][: r.n_tokens].tobytes()) == r.checksum for r in index)
    encoding = vocabulary.encoding()
    stream = np.concatenate([in_order[r.slot][: r.n_tokens] for r in index]).tolist()
    texts, text = Counter(), []
    for token in stream:
        if token == vocabulary.end:
            texts[encoding.decode(text)] += 1
            text = []
        else:
            text.append(token)
    assert texts == Counter(t or "" for _, t in rows)
    assert [x.tolist() for x in made.read(40, 30)] == [x.tolist() for x in in_order[40:70]]
    assert training_order.materialise(docs_of(spark, []), vocabulary).rows.collect() == []


# ---- Licences ----

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licenses(spark):
    cases = {
        1: ("Some text.\nReleased under the MIT License.", ("MIT", "MIT")),
        2: (MIT, ("MIT", "MIT")),
        3: ("no stop before\nLICENSED under  the Apache Licence, version 2.0.\nnor after", ("Apache-2.0", "Apache-2.0")),
        4: ("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
            ("GPL-3.0-only,CC-BY-NC-4.0", "GPL-3.0-only")),
        5: ("Licensed under nothing. The MIT License", ("", None)),
        6: (None, ("", None)), 7: ("", ("", None)),
        8: ("x. " * 20_000 + "Licensed under CC BY-NC 4.0.", ("CC-BY-NC-4.0", "CC-BY-NC-4.0")),
    }
    rows = [(i, t) for i, (t, _) in cases.items()] + [(None, cases[1][0]), (1, cases[1][0])]
    got = licenses.scan_licenses(docs_of(spark, rows, True)).collect()
    assert Counter((r.doc_id, r.licenses, r.license) for r in got) == Counter(
        [(i, *w) for i, (_, w) in cases.items()] + [(None, "MIT", "MIT"), (1, "MIT", "MIT")]
    )
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].sentence_ids == "MITTitle,MITGrant,MITNotice,MITWarranty,MITLiability"
    assert by_id[6].n_sentences == by_id[7].n_sentences == 0
    assert licenses.scan_licenses(docs_of(spark, [])).collect() == []
    assert licenses.scan_licenses(docs_of(spark, [(1, "MIT License")]), known=(), rules=()).first().licenses == ""


# ---- URL filter ----

RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.net", "/en/", "block"),
         ("a.b.example.net", "/e", "allow"), ("", "", "block"), (None, None, "allow"), ("org", "/fr", "allow")]


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = []
    for h, p, v in rules:
        h, p = lower(h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://X.NET/?q", "http://www.Example.net/en/a?b#c",
            "http://a.b.example.net/en/x", "http://xa.b.example.net/e", "http://x.a.b.example.net/e", "ftp://org/fr",
            "x://notnet/", "http://net./", "http://é.org/frü", "http://a?://net/", "a://b://net/", "http://" + "l." * 300 + "net/" + "p/" * 9000]
    pages = [(k if k else None, u, "x", "y") for k, u in enumerate(urls)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string")
    for rules in (RULES, RULES[:4], []):
        table = (url_filter.rule_table(spark, rules) if rules
                 else spark.createDataFrame([], "host string, path string, verdict string"))
        got = url_filter.judge_urls(df, table, default="allow").collect()
        assert Counter(map(tuple, got)) == Counter((i, *brute_verdict(u, rules)) for i, u, *_ in pages)
    assert url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark, RULES)).collect() == []


@pytest.mark.parametrize("options", [{}, {"range_bytes": 200, "page_blocks": 2, "broadcast_bytes": 640}, {"order": 1}, {"order": 2, "min_count": 2}])
def test_lm_score_is_that_of_exact_quantised_counts(spark, options):
    s = lm_scoring.Settings(bits_per_entry=96, **options)
    rows = [(k, " ".join(f"w{k * j % 19}" for j in range(k % 40))) for k in range(90)] + [(None, "w1 w2 new"), (91, None)]
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    grams = Counter()
    for t in learned:
        tokens = [None, *(t or "").split(), None]
        for k in range(1, s.order + 1):
            grams.update(tuple(tokens[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(tokens)))
    level = lambda g: 1 + math.floor(math.log(grams[g]) / math.log(s.base) + 1e-9)
    middle = lm_scoring.level_counts(s.base)
    kept = {g: middle[level(g)] for g, n in grams.items() if len(g) == 1 or n >= s.min_count}
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def score(text):
        tokens, total = [None, *(text or "").split(), None], 0.0
        for i in range(1, len(tokens)):
            p = (min(kept.get((tokens[i],), 0), n) + 1) / (n + v + 1)
            for k in range(2, min(s.order, i + 1) + 1):
                before = kept.get(tuple(tokens[i - k + 1 : i]), 0)
                p = (min(kept.get(tuple(tokens[i - k + 1 : i + 1]), 0), before) + s.weight * p) / (before + s.weight)
            total += math.log10(p)
        return total

    got = lm_scoring.lm_digest(docs_of(spark, rows), s).collect()
    assert sorted(round(r.score, 6) for r in got) == sorted(round(score(t), 6) for _, t in rows)


def test_lm_runs_keep_keys_and_counts():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    half = keys[::2], rng.integers(1, 1 << 40, len(keys[::2]))
    merged = lm_scoring._merge([lm_scoring._pack(keys, np.ones(len(keys), dtype=np.int64)), lm_scoring._pack(*half)])
    want = dict.fromkeys(keys.tolist(), 1)
    for k, c in zip(half[0].tolist(), half[1].tolist()):
        want[k] += c
    assert dict(zip(merged[0].tolist(), merged[1].tolist())) == want


def test_lm_refuses_a_base_with_too_many_levels():
    with pytest.raises(ValueError, match="levels"):
        lm_scoring.Settings(base=1.05)
    assert len(lm_scoring.level_counts(1.5)) > lm_scoring.levels_of(np.array([1 << 62]), 1.5)[0]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    from rolesift.llm import word_hashes

    parts = [f"w{k}" for k in range(300)] + ["ab", "ba", "a", "aa", "a\x00", "\x00", "é" * 40]
    hashes, at = word_hashes.hash_words("  ".join(parts).encode() + b" ")
    assert len(set(hashes.tolist()) | {int(word_hashes.SPACE)}) == len(parts) + 1
    for part, value, place in zip(parts, hashes, at):
        assert word_hashes.hash_words(b"   " + part.encode())[0].tolist() == [value]
        assert "  ".join(parts).encode()[place:].startswith(part.encode())
    long = [b"x" * n for n in (word_hashes.BLOCK - 1, word_hashes.BLOCK, word_hashes.BLOCK + 1, 3 * word_hashes.BLOCK)]
    values = [word_hashes.hash_words(w)[0].tolist() for w in long]
    assert len({v for v, in values}) == len(long)
    total, power = 0, pow(int(word_hashes.FACTOR), word_hashes.BLOCK, 1 << 64)
    for byte in long[2]:
        total = (total + int(word_hashes.BYTE[byte]) * power) % (1 << 64)
        power = power * int(word_hashes.FACTOR) % (1 << 64)
    assert bloom.mix(np.array([total], dtype=np.uint64)).tolist() == values[2]
    assert word_hashes.hash_words(b"")[0].tolist() == word_hashes.hash_words(b"  ")[0].tolist() == []


def test_lm_pieces_of_long_texts_are_those_of_the_whole(spark):
    from rolesift.llm import word_hashes

    long = " ".join(f"w{k % 7919}" for k in range(120_000))
    texts = ["a b", "", None, long, "y" * (word_hashes.BLOCK + 9) + " tail", "c"]
    chunks = list(lm_scoring._chunks([pa.scalar(t and t.encode(), pa.binary()) for t in texts], 3, 20_000))
    assert len(chunks) > 1
    for k in range(1, 4):
        got = [v for c in chunks for v in c.keys(k, 48)[c.own & (c.off >= k - 1)].tolist()]
        ids = []
        for t in texts:
            tokens = np.array([word_hashes.SPACE, *(word_hashes.hash_words(w.encode())[0][0] for w in (t or "").split()),
                               word_hashes.SPACE])
            whole = lm_scoring._Chunk(tokens, np.arange(len(tokens)), np.arange(len(tokens)) > 0, tokens)
            ids += whole.keys(k, 48)[max(1, k - 1):].tolist()
        assert got == ids


def test_lm_long_texts_score_alike_in_one_part_and_in_many(spark):
    rows = [(k, " ".join(f"w{k * j % 4001}" for j in range(n))) for k, n in enumerate([5, 90_000, 0, 120_000, 40, 3])]
    scores = [
        {r.doc_id: (r.score, r.n_known) for r in lm_scoring.lm_digest(docs_of(spark, rows), s).collect()}
        for s in (lm_scoring.Settings(bits_per_entry=96), lm_scoring.Settings(bits_per_entry=96, broadcast_bytes=64 << 10))
    ]
    assert scores[0].keys() == scores[1].keys() == {k for k, _ in rows}
    assert all(abs(scores[0][k][0] - scores[1][k][0]) < 1e-6 * abs(scores[0][k][0]) for k in scores[0])


def test_lm_hands_python_few_bytes_at_a_time(spark, monkeypatch, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = " ".join(f"w{k}" for k in range(1500))
    docs = docs_of(spark, [(k, text) for k in range(2000)]).coalesce(1)  # 16 MB in one partition

    def watched(name):
        real, log = getattr(lm_scoring, name), str(tmp_path / name)

        def step(batches, **options):
            def told():
                for batch in batches:
                    with open(log, "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return real(told(), **options)

        monkeypatch.setattr(lm_scoring, name, step)

    for name in ("_count", "_score"):
        watched(name)
    got = lm_scoring.lm_digest(docs, lm_scoring.Settings(broadcast_bytes=32 << 10)).collect()
    assert len(got) == 2000 and len({round(r.score, 6) for r in got}) == 1
    for name in ("_count", "_score"):
        sizes = [int(x) for x in (tmp_path / name).read_text().split()]
        assert sum(sizes) > 10_000_000 and max(sizes) < 2 * lm_scoring._BATCH_BYTES
    assert spark.conf.get(key, None) is None
    try:
        spark.conf.set(key, 1 << 20)
        lm_scoring.lm_digest(docs.limit(1)).collect()
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)


def test_lm_scoring_reads_each_text_once_whatever_the_filters_size(spark, monkeypatch, tmp_path):
    rows = [(k, " ".join(f"w{k * j % 211}" for j in range(60))) for k in range(300)] + [(None, None), (7, "")]
    whole = {(r.doc_id, r.n_tokens, r.n_known): r.score
             for r in lm_scoring.lm_digest(docs_of(spark, rows), lm_scoring.Settings(bits_per_entry=96)).collect()}
    real, log = lm_scoring._score, str(tmp_path / "score")

    def score(batches, **options):
        def told():
            for batch in batches:
                with open(log, "a") as f:
                    f.write(f"{len(batch.column('_id').drop_null())}\n")
                yield batch

        return real(told(), **options)

    monkeypatch.setattr(lm_scoring, "_score", score)
    s = lm_scoring.Settings(bits_per_entry=96, range_bytes=4096, broadcast_bytes=8 << 10)
    got = lm_scoring.lm_digest(docs_of(spark, rows), s).collect()
    assert sum(map(int, (tmp_path / "score").read_text().split())) == len(rows) - 1
    assert len(got) == len(rows)
    assert all(abs(whole[r.doc_id, r.n_tokens, r.n_known] - r.score) < 1e-6 for r in got)
    model = lm_scoring.train(docs_of(spark, rows).select(F.col("text").cast("binary").alias("text")), s)
    assert len(model.ends) > 10 * model.part_ranges and model.blocks * bloom.BLOCK_BITS // 8 > 10 * s.broadcast_bytes


def test_lm_block_read_by_two_tasks_gets_all_its_answers():
    texts = [f"w{k} w{k + 1} again" for k in range(40)]
    shared = type("Shared", (), {"value": lm_scoring._Known(lm_scoring.Settings(), (np.zeros(0, np.uint64), np.zeros(0)), 9, 5)})
    ends, per = np.cumsum(np.full(6, 10)), 2
    block, row = pa.array([0] * 40), pa.array(range(40))
    read = pa.RecordBatch.from_arrays([block, row, pa.array([t.encode() for t in texts])], names=["block", "_row", "text"])
    asked = [b for a, n in ((0, 13), (13, 27)) for b in lm_scoring._ask(iter([read.slice(a, n)]), shared.value.settings, len(ends), per)]
    asked = pa.Table.from_batches(asked).sort_by("part").to_batches()
    pages = pa.RecordBatch.from_pylist([
        {"part": r // per, "page": 0, "_row": r, "run": np.full(80, -1, dtype=np.int64).tobytes()} for r in range(6)
    ], schema=asked[0].schema)
    dealt = pa.Table.from_batches([pages, *asked]).sort_by([("part", "ascending"), ("page", "ascending")]).to_batches()
    found = pa.Table.from_batches(lm_scoring._answer(iter(dealt), shared.value.settings, ends, per)).to_pylist()
    assert {f["_row"] for f in found} == {0, 13}
    rows = [f | {"_id": None, "text": None} for f in found]
    rows += [{"part": None, "_row": k, "piece": None, "longer": None, "run": None, "_id": k, "text": t.encode()} for k, t in enumerate(texts)]
    rows.sort(key=lambda r: (r["_row"], r["piece"] is None, r["piece"] or 0, r["longer"] or False, r["part"] or 0))
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 7], schema=pa.RecordBatch.from_pylist(rows).schema) for a in range(0, len(rows), 7)]
    got = pa.Table.from_batches(lm_scoring._score(iter(batches), shared)).to_pydict()
    assert got["_id"] == got["_row"] == list(range(40)) and got["n_tokens"] == [4] * 40
    assert len(got["keys"][0]) == 4  # a filter of ones only may hold every word


def test_lm_runs_are_packed_together_as_each_alone():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
    counts, starts = rng.integers(0, 1 << 20, len(keys)).astype(np.uint64), np.array([0, 1, 7, 200])
    runs = lm_scoring._pack_runs(keys, counts, starts)
    assert runs == [lm_scoring._pack(keys[a:z], counts[a:z]) for a, z in zip(starts, [*starts[1:], len(keys)])]
    assert [lm_scoring._run_length(r) for r in runs] == [1, 6, 193, len(keys) - 200]
    unpacked = lm_scoring._unpack_runs(runs)
    assert (unpacked[0] == keys).all() and (unpacked[1] == counts).all()
    assert [len(a) for a in lm_scoring._unpack_runs([])] == [0, 0] and lm_scoring._pack_runs(keys[:0], counts[:0], starts[:0]) == []


def test_shuffle_files_go_when_a_write_has_run(spark, tmp_path):
    from rolesift.session import drop_shuffles

    key, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(tmp_path)
    with drop_shuffles(spark):
        assert spark.conf.get(key) == "true"
        spark.range(1000).repartition(3, "id").write.parquet(f"{folder}/a")
    assert spark.read.parquet(f"{folder}/a").count() == 1000
    spark.conf.set(key, "false")
    try:
        with drop_shuffles(spark):
            assert spark.conf.get(key) == "false"
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)
