"""Operators 11 to 13: exact dedup, hard negatives, importance resampling."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from logtide.llm import exact, negatives, queries, resampling

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_hard_negatives", "op13_resampling"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, frame.collect()), key=key) == sorted(theirs, key=key)


# --- exact dedup -------------------------------------------------------------

def test_odd_rows_keep_one_of_each_text(odd, none):
    rows, got = odd.select("doc_id", "text").collect(), exact.keep_one(odd).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()].append(r.doc_id)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
    assert exact.keep_one(none).collect() == []


def test_only_ascii_letters_are_lowered(spark):
    texts = ["Ä", "ä", "K", "K", "k", "İ", "i", "STRASSE ß", "strasse ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.keep_id for r in exact.keep_one(docs).collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if u.translate(LOWER) == t.translate(LOWER)) for i, t in enumerate(texts)}


def test_index_takes_in_new_data_and_outlives_its_session(spark, folder):
    def batch(*rows):
        return exact.digests(spark.createDataFrame(list(rows), "doc_id bigint, text string"))

    index = exact.DigestIndex(spark, folder, buckets=4)
    index.append(batch((1, "a"), (2, "A"), (3, "b")))
    second = batch((4, "B"), (5, "c"), (6, None), (7, ""))
    assert sorted(r.keep_id for r in index.unseen(second).collect()) == [5, 7]
    index.append(second)
    index.append(second)  # a repeated append changes nothing
    kept = {2, 3, 5, 7}
    assert {r.keep_id for r in index.read().collect()} == kept and index.read().count() == len(kept)
    index.close()
    again = exact.DigestIndex(spark, folder, buckets=99)  # what is there decides
    assert again.buckets == 4 and {r.keep_id for r in again.read().collect()} == kept
    again.compact()
    assert {r.keep_id for r in again.read().collect()} == kept
    assert exact.DigestIndex(spark, folder).number == 1
    again.append(batch((8, "C"), (9, "d")))
    assert {r.keep_id for r in again.read().collect()} == kept | {9}


def test_index_is_not_moved_for_new_data(spark, folder):
    index = exact.DigestIndex(spark, folder, buckets=4)
    new = exact.digests(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    index.append(new)
    plan = index.unseen(new)._jdf.queryExecution().executedPlan().toString()
    left, right = plan.split("SortMergeJoin", 1)[1].split("FileScan", 2)[::2]
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in right and "SortAggregate" not in plan


# --- hard negatives ----------------------------------------------------------

def plain_negatives(rows, every):
    """(anchor, positive, rank, negative, scores) by exact whole numbers."""
    vectors = []
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(c)) for c in x]
        if sum(c * c for c in v) < 2**60:
            vectors.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, v))
    out = []
    for a, la, va in vectors:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in vectors if i != a]
        for ps, p, _ in sorted(s for s in scores if s[2] == la)[:5]:
            fit = sorted(s for s in scores if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(a, p, k, n, -ps, -s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 3, rows[50][2]) for i in range(40)]  # ties with an anchor's vector
    rows += [(400, 1, None), (401, None, [1.0]), (402, 1, [1.0, None]), (403, 1, [math.nan]), (404, 2, [math.inf]),
             (405, 1, []), (406, 2, [3.0]), (407, 1, [1.0] * 9), (408, 1, [1e30]), (409, 3, [300.0, -200.5]), (None, 1, [1.0]),
             (450, 0, [])]
    schema = "vec_id bigint, label int, embedding array<double>, row string, block string, kind int, width int, place int"
    frame = spark.createDataFrame([(*r[:2], r[2], "x", "y", 1, 2, 3) for r in rows], schema).repartition(5)
    got = sorted(map(tuple, negatives.mine(frame).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows, 50) and len(got) > 20
    assert negatives.mine(frame.filter("false")).collect() == []


def test_repeated_anchor_gives_its_rows_again(spark):
    rows = [(50, 1, [1.0, 0.0]), (50, 1, [1.0, 0.0]), (51, 1, [1.0, 0.0]), (52, 2, [0.9, 0.1]), (52, 2, [0.9, 0.1])]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")).collect()
    assert sorted((r.positive_id, r["rank"], r.negative_id) for r in got) == [(51, 1, 52), (51, 1, 52), (51, 2, 52), (51, 2, 52)]


@pytest.mark.parametrize("columns,largest", [(1, 2**29), (64, 400), (100, 2**25), (5_000, 2**20), (3, 5)])
def test_residues_give_exact_scores(columns, largest):
    rng = np.random.default_rng(columns)
    a, b = (rng.integers(-largest, largest + 1, (n, columns)) for n in (7, 11))
    squared = max(int((v.astype(object) ** 2).sum(1).max()) for v in (a, b))
    system = negatives.Residues(columns, squared)
    assert (system.scores(system.take(a), system.take(b)) == (a.astype(object) @ b.T.astype(object))).all()
    assert all((p // 2) ** 2 * min(columns, negatives.PANEL) < 2**24 for p in system.primes)
    assert math.prod(system.primes) > 2 * squared


# --- resampling --------------------------------------------------------------

def plain_sample(docs, target, runs, min_words, per_cent):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall((text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000 for k in range(1, runs + 1) for i in range(len(words) - k + 1)]

    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in source}
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    places = {id(r): k for k, r in enumerate(fit[:per_cent * len(fit) // 100], 1)}
    return [(*r[:4], places.get(id(r))) for r in rows]


ORDER = lambda r: tuple((v is None, v or 0) for v in r)


@pytest.mark.parametrize("runs,min_words,per_cent", [(1, 3, 50), (3, 1, 100), (2, 0, 30)])
def test_sample_of_odd_rows(spark, odd, none, runs, min_words, per_cent):
    target = spark.createDataFrame([("The lazy DOG, again",), (None,), ("",), ("été word",)], "text string")
    got = [tuple(r) for r in resampling.resample(odd, target, runs, min_words, per_cent).collect()]
    want = plain_sample([tuple(r) for r in odd.select("doc_id", "text").collect()], [r.text for r in target.collect()], runs, min_words, per_cent)
    assert sorted(got, key=ORDER) == sorted(want, key=ORDER)
    assert resampling.resample(none, target).collect() == []
    assert len(resampling.resample(odd, target.filter("false")).collect()) == odd.count()


def test_long_text_is_cut_between_words(monkeypatch):
    text = "Über straße x1 y2, " * 300 + "a" * 500 + " end"
    whole = resampling.Features(3)(text, resampling._Buckets())
    spans = resampling.Words()(text)
    monkeypatch.setattr(resampling, "PART", 37)
    parts = resampling.Features(3)(text, resampling._Buckets())
    assert whole[0] == parts[0] and Counter(whole[1].tolist()) == Counter(parts[1].tolist())
    assert spans == resampling.Words()(text) and all(text[a:b].translate(LOWER) == w for w, a, b in spans)


def test_ranks_need_no_window_over_all_rows(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS score")
    from pyspark.sql import functions as F

    placed = resampling.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert [(r.doc_id) for r in sorted(placed.collect(), key=lambda r: r["rank"])] == [i for _, i in want]
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
