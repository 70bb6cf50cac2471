"""The filter audit, spelling variants and quality rules on small inputs, against brute force."""

import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesift.llm import filter_audit, quality, spans, spelling
from tests.llm.test_queries import SF

LETTERS = ["a", "B", " ", "\n", "é", "€", "#", "ab ", "x\t", "　", "\U0001F600", "\x0b", "\x00", "Zz"]


@pytest.fixture(params=[7, 60, 1 << 20])
def chunk_bytes(request, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK_BYTES", request.param)


def random_texts(seed, n=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


def test_measure(chunk_bytes):
    texts = random_texts(1)
    got = filter_audit.measure([t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = text.encode().split()
        want = [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]
        assert [int(v[i]) for v in got.values()] == want


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "scramble", lambda h: np.zeros_like(h))
    text = b"aa bb aa cc bb dd aa"
    assert filter_audit.measure([text, b"aa", text])["n_distinct"].tolist() == [4, 1, 4]


def audit_rows(spark, docs, labels):
    return filter_audit.audit_digest(
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_audit_against_each_order(spark):
    rnd = random.Random(2)
    words = ["one", "Two", "THREE", "four", "#", "six", "seven"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 250]))) for _ in range(20)] + [None, ""]
    texts += [" ".join(f"w{i}" for i in range(300)), "  ".join(["x"] * 300)]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice([None, "", "a", "b"])) for _ in range(150)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, 6, None]]
    got = {(r.part, r.filter_order, r.step): r for r in audit_rows(spark, docs, labels).collect()}

    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        w = text.split()
        failed = {f for f, is_bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text],
        }.items() if is_bad}
        parts.setdefault(lang or "", []).append((i, failed))
    shares = {(p, f): 0 for p in parts for f in "ABCDE"}
    want = {}
    for p, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                want[p, order, k + 1] = (
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
                shares[p, f] += len(gone)
    assert got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == values
        assert r.shapley == shares[key[0], key[1][key[2] - 1]]


def test_audit_edges(spark):
    assert audit_rows(spark, [], []).count() == 0
    docs = spark.createDataFrame(
        [(1, "a b", "x", 5, "#"), (2, "a b", "x", 5, "#")], "doc_id long, text string, lang string, `n.words` int, TEXT string"
    ).withColumns({"_text": F.lit(1), "digest": F.lit(2), "part": F.lit("q")})
    labels = spark.createDataFrame([(2, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    last = {r.filter_order: r for r in filter_audit.audit_digest(docs, labels).filter("step = 1").collect()}
    assert last["EABCD"].removed == 1 and last["EABCD"].good_lost == 1 and last["ABCDE"].removed == 2
    assert {r.part for r in last.values()} == {"x"} and last["DABCE"].removed == 0
    with pytest.raises(ValueError):
        filter_audit.audit(docs, {"AB": F.lit(True)}, "lang", [])


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def random_words(seed, n, longest=9, letters="abé"):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(40))
def test_near_pairs(seed):
    words = random_words(seed, 60, 3 + seed % 6, "ab" if seed % 2 else "abcé")
    got = [(i, j) for i, j, _ in spelling.near_pairs(words)]
    assert sorted(got) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


@pytest.mark.parametrize("most", [1, 5, 1024])
def test_variant_groups(spark, most):
    words = random_words(5, 250)
    rnd = random.Random(most)
    n = {w: 10 ** rnd.randint(0, 4) for w in words}
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"), most=most).collect()}
    assert got.keys() == n.keys()
    form = {}
    for w in words:
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        assert (got[w].n, got[w].n_near, got[w].form) == (n[w], len(others), form[w])
        assert got[w].form_n == (n[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        assert got[w].root == root
    assert any(form[f] for f in form.values() if f)


def test_near_words_of_one_shared_beginning_and_long_words(spark):
    words = ["prefix" * 3 + w for w in random_words(6, 300, 5)] + ["q" * 5_000, "q" * 5_001, "q" * 2_000 + "r" + "q" * 3_000]
    rows = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most=20).collect()
    assert {r.word: r.n_near for r in rows} == {w: sum(near(w, x) for x in words) for w in words}


def test_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE_BYTES", 50)
    rnd = random.Random(7)
    pieces = ["Wörterbuch", "straße", "ÉCOLES", "naïvement", "×÷×÷×÷×÷", "plainword", "PLAINWORD", "日本語", "a1b", "ōmegaomega"]
    docs = [(rnd.choice([None, *range(30)]), "".join(rnd.choice(pieces) + rnd.choice([" ", "\n", "-", "9"]) for _ in range(40))) for _ in range(60)]
    docs += [(3, None), (4, ""), (5, "zzzzzzzz" * 100)] * 2
    got = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = Counter()
    inside = lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or "\xc0" <= c <= "\xff"
    for i, text in docs:
        for run in "".join(c if inside(c) else " " for c in text or "").split():
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_spelling_edges(spark):
    none = spelling.spelling_digest(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.count() == 0
    docs = spark.createDataFrame([(1, "lonelyword " * 3, "x")], "doc_id long, text string, word string").withColumn("a.b", F.lit(1))
    assert [tuple(r) for r in spelling.spelling_digest(docs).collect()] == [("lonelyword", None, "lonelyword", 3, 0, None)]


def slow_counts(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (len(words), len("".join(w.decode() for w in words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts():
    rnd = random.Random(8)
    texts = random_texts(9) + ["", " \n ", "a a a a", "a b c a b", "a b c a b c", "x\nx\n\nx \n"]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    for text in texts:
        assert quality.base_counts(text.encode()) == slow_counts(text)


def test_features_do_not_depend_on_chunks(monkeypatch):
    t = quality.Training(bits=12)
    texts = [x.encode() for x in random_texts(10, 30)]
    weights = np.random.default_rng(1).normal(size=1 << t.bits)
    whole = quality.log_odds(texts, weights, 0.5, t)
    assert np.allclose(whole, [quality.log_odds([x], weights, 0.5, t)[0] for x in texts])


def test_calibration_is_close_to_the_share():
    rng = np.random.default_rng(2)
    score = rng.normal(size=20_000) * 40 + 900
    good = rng.random(20_000) < 1 / (1 + np.exp(-(0.05 * (score - 900) + 0.7)))
    slope, offset = quality._log_odds_fit(score, good)
    assert abs(slope - 0.05) < 0.005 and abs(slope * 900 + offset - 0.7) < 0.1
    slope, offset = quality._log_odds_fit(np.array([1.0, 2.0, 10.0, 1e6]), np.array([False, False, True, True]))
    assert np.isfinite([slope, offset]).all() and slope > 0


def test_quality_on_held_out_rows(spark):
    """Held-out accuracy on the 4,000 labelled rows of the largest tables."""
    d = SF.replace("0.001", "0.1")
    got = quality.quality_digest(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = got.filter("held_out and not base_failed").toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").df()
    both = rows.merge(labels, on="doc_id")
    good = both.quality == 1
    assert good.sum() > 500 and (~good).sum() > 50
    assert both.kept[good].mean() > 0.98 and both.kept[~good].mean() < 0.25
    # Calibrated: the mean probability is near the share of good rows
    assert abs(both.score.mean() - good.mean()) < 0.05


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (1, ""), (None, "word " * 60), (2, " ".join(f"w{i}" for i in range(60))), (2, "short")], "doc_id long, text string"
    ).withColumns({"score": F.lit("x"), "_id": F.lit(1), "a.b": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_digest(docs, none).collect()
    assert [(r.doc_id, r.base_failed, r.kept) for r in rows] == [
        (1, True, False), (1, True, False), (None, True, False), (2, False, True), (2, True, False)]
    assert rows[2].held_out and {r.score for r in rows} == {1.0}
    assert quality.quality_digest(docs.limit(0), none).count() == 0
    both = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_digest(docs, both).collect())
