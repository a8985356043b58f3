"""Operators over the whole table beside brute force, on odd rows and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logtide.llm import mixing, shards, simhash, toxicity

SF = "/root/testdata/sf0.001"


# -- mixing (operator 4)

def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, share=1.5):
    """Targets by the definition: deal by weight, cap, deal the excess again."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    out, open_ones, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while left > 1e-9 and open_ones:
        total, given = sum(weights[s] for s in open_ones), left
        left = 0.0
        for s in list(open_ones):
            out[s] += given * weights[s] / total
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_ones.remove(s)
    return out


@pytest.mark.parametrize("cell", [1_000, 3])
def test_mix(spark, odd, none, cell, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.select("doc_id", "source", "text").collect()
        sizes, largest = collections.Counter(), collections.Counter()
        for r in rows:
            sizes[r.source] += size_of(r.text)
            largest[r.source] = max(largest[r.source], size_of(r.text))
        wanted = filled(sizes)
        got = mixing.mix_plan(docs).collect()
        assert len(got) == len(rows)
        assert sorted(r["size"] for r in got) == sorted(size_of(r.text) for r in rows)
        assert all(r.taken <= 2 * r["size"] and r.taken == r["size"] * r.times for r in got)
        budget = math.floor(sum(wanted.values()) + 1e-6)
        assert budget - max(largest.values()) <= sum(r.taken for r in got) <= budget
        names = {r.doc_id: r.source for r in rows}
        taken = collections.Counter()
        for r in got:
            if r.doc_id is not None:
                assert r.target == pytest.approx(wanted[names[r.doc_id]]) and r.source_size == sizes[names[r.doc_id]]
            taken[r.target, r.source_size] += r.taken
        if docs is not odd:
            for (target, source_size), n in taken.items():
                assert abs(n - target) <= max(largest.values())
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_rows_follow_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r.times for r in mixing.mix_plan(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {d: n for d, n in plan.items() if n}


# -- toxicity (operator 6)

INSULTS = ("brzgfool", "qvoxnaard")


@pytest.fixture(scope="module")
def scored_docs(spark):
    rng = np.random.default_rng(4)
    calm = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(60)]
    rows = []
    for i in range(400):
        words = list(rng.choice(calm, 40))
        if i % 8 == 0:
            words[int(rng.integers(40))] = f"{INSULTS[i % 16 // 8]}{rng.choice(['', 's', 'er'])}"
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxic_words_are_found_in_held_out_texts(scored_docs):
    docs, labels, truth = scored_docs
    rows = toxicity.score(docs, labels, F.col("doc_id") % 5 != 0).filter("doc_id % 5 = 0").collect()
    assert all(r.predicted == truth[r.doc_id] for r in rows) and len(rows) == 80
    assert all(0 <= r.score <= 1 for r in rows)


CLEAN = ("zyqvoxprint", "kowalczykmedia", "xj4kq9fhw2", "thorvaldsen", "maplewoodgazette")


@pytest.mark.parametrize("holders", [(8,), (8, 16)])
def test_clean_words_of_few_toxic_texts_are_no_insults(scored_docs, holders):
    docs, labels, truth = scored_docs
    held = [i for i in range(1, 400) if i % 5 == 0 and not truth[i]][:len(CLEAN)]
    words = {**dict.fromkeys(holders, " ".join(CLEAN)), **dict(zip(held, CLEAN))}
    rows = [(r.doc_id, f"{r.text} {words.get(r.doc_id, '')}") for r in docs.collect()]
    planted = docs.sparkSession.createDataFrame(rows, docs.schema)
    found = toxicity.score(planted, labels, F.col("doc_id") % 5 != 0).filter("doc_id % 5 = 0").collect()
    assert all(r.predicted == truth[r.doc_id] for r in found) and set(held) <= {r.doc_id for r in found}


def test_probabilities_are_kneser_ney(scored_docs):
    """Word evidence beside the recursion written out over dicts."""
    docs, labels, truth = scored_docs
    texts = docs.collect()
    words = [collections.Counter(), collections.Counter()]
    for r in texts:
        words[truth[r.doc_id]].update(set(r.text.split()))
    levels = [{}, {}]
    for k in (0, 1):
        counts = collections.Counter()
        for word, n in words[k].items():
            line = "^" * 5 + word + "$"
            for i in range(5, len(line)):
                counts[line[i - 5: i + 1]] += n
        levels[k][6] = counts
        for order in (5, 4, 3, 2):
            levels[k][order] = collections.Counter(g[1:] for g in levels[k][order + 1])
    shared = set(levels[0][2]) | set(levels[1][2])
    for order in (1,):
        counts = collections.Counter(g[1:] for g in shared)
        levels[0][order] = levels[1][order] = counts
        shared = set(counts)
    sums = [{o: collections.Counter() for o in range(1, 7)} for _ in (0, 1)]
    kinds = [{o: collections.Counter() for o in range(1, 7)} for _ in (0, 1)]
    for k in (0, 1):
        for o in range(1, 7):
            for g, n in levels[k][o].items():
                sums[k][o][g[:-1]] += n
                kinds[k][o][g[:-1]] += 1

    def log_p(k, word):
        total, line = 0.0, "^" * 5 + word + "$"
        for i in range(5, len(line)):
            p = 1 / 1024
            for o in range(1, 7):
                g = line[i - o + 1: i + 1]
                n = sums[k][o][g[:-1]]
                if n:
                    p = max(levels[k][o][g] - 0.75, 0) / n + 0.75 * kinds[k][o][g[:-1]] / n * p
            total += math.log(p)
        return total

    model = toxicity.Model(toxicity.learn(docs, labels, F.lit(True)).value)
    tried = [*INSULTS, "aeinr", "stain", "brzg", "unseen", "a", "rates"]
    wanted = [(log_p(1, w) - log_p(0, w)) / (len(w) + 1) for w in tried]
    assert np.allclose(model.word_evidence(tried), wanted, atol=0.12)  # counts are kept to 4.5 per cent


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 0), (None, 1), (8, None), (99, 1)], "doc_id bigint, toxic int")
    rows = toxicity.score(odd, labels, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id in (2, 3, 4)} == {0}
    unlearned = toxicity.score(odd, labels.filter("false"), F.lit(True)).collect()
    assert len({r.score for r in unlearned}) == 1
    assert toxicity.score(none, labels, F.lit(True)).count() == 0
    assert toxicity.accepted(odd, labels, F.lit(True)).columns == odd.columns


# -- shards (operator 7)

def least_capacity(sizes, count):
    def needed(capacity):
        parts, room = 1, capacity
        for n in sizes:
            if n > capacity:
                return count + 1
            if n > room:
                parts, room = parts + 1, capacity
            room -= n
        return parts
    low, high = 1, sum(sizes) or 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= count else (middle + 1, high)
    return low


@pytest.mark.parametrize("cell", [1_000, 2])
def test_shards(spark, odd, none, cell, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", cell)
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        groups, texts = collections.Counter(), {}
        for r in docs.collect():
            data = (r.text or "").encode()
            groups[hashlib.md5(data).hexdigest()] += len(data) + 1
            texts[r.doc_id] = data
        got = shards.assign(docs).collect()
        loads, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for r in got:
            loads[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            if r.doc_id is not None:
                homes[texts[r.doc_id]].add(r.shard)
                assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert len(got) == docs.count() and set(loads) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(h) == 1 for h in homes.values())
        best = least_capacity([groups[g] for g in sorted(groups)], 8)
        assert max(loads.values()) == best == got[0].capacity
    assert shards.assign(none).count() == 0


def test_sharding_plan_has_no_python(spark):
    plan = shards.assign(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- SimHash (operator 10)

def plain_print(text, width):
    words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    spans = [" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """Least id of each row's component; prints: (id, fingerprint) rows."""
    unique = sorted({p for _, p in prints})
    parent = {p: p for p in unique}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(unique):
        for b in unique[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[root(p)] = min(least.get(root(p), doc), doc)
    return [(doc, p, least.get(root(p))) for doc, p in prints]


def test_near_duplicates(spark, odd, none):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet").limit(120)):
        wanted = plain_components([(r.doc_id, plain_print(r.text, 4)) for r in docs.collect()], 4)
        got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("distance", [2, 4, 6])
def test_links_connect_dense_clusters_and_chains(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
            for b in base[:20] for n in rng.integers(1, distance + 3, 12)]
    dense = [base[50] ^ np.uint64(x) for x in range(0, 512, 3)]
    chain = [base[51] ^ np.uint64((1 << 4 * i) - 1) for i in range(10)]
    points = np.unique(np.concatenate([base, np.array(near + dense + chain, np.uint64)]))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    edges = simhash.links(frame, distance)
    found = {r.v % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    assert all(((a ^ b) % (1 << 64)).bit_count() <= distance for a, b in edges.collect())
    mine = collections.defaultdict(set)
    for p in map(int, points):
        mine[found.get(p, p)].add(p)
    theirs = collections.defaultdict(set)
    for p, q, root in plain_components([(int(p), int(p)) for p in points], distance):
        theirs[root].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_buckets_are_exact():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
                                       ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centres]))
    links = simhash.bucket_links(points, 4)
    assert len(links) < len(points)
    forest = simhash.Forest(len(points))
    for a, b in links:
        assert np.bitwise_count(points[a] ^ points[b]) <= 4
        forest.join(a, b)
    wanted = plain_components([(int(p), int(p)) for p in points], 4)
    roots = {int(p): forest.root(i) for i, p in enumerate(points)}
    groups = collections.defaultdict(set)
    for p, _, root in wanted:
        groups[root].add(roots[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(roots.values()))


def test_keep_one_leaves_one_row_a_group(odd):
    kept = simhash.keep_one(odd, 4, 4)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({p for _, _, p in plain_components([(i, plain_print(r.text, 4)) for i, r in enumerate(odd.collect())], 4)})
    ids = [r.doc_id for r in rows]
    assert 1 in ids and 2 in ids and 9 not in ids and 3 not in ids


@pytest.mark.parametrize("budget", [0, 1, 6, 7, 50, 4_000, 5_000, 100_000])
def test_the_mix_ends_where_a_plain_sum_does(spark, budget):
    rows = [(float(i // 7), i % 3, f"{i * 7919 % 1000:04d}", "t", i % 11 + 1) for i in range(1_000)]
    frame = spark.createDataFrame(rows, "finish double, place int, turn_key string, tie string, size bigint")
    total, want = 0, None
    for r in sorted(rows):
        total += r[4]
        if total > budget:
            break
        want = r[:4]
    assert mixing.last_within(frame, budget) == want
