"""Operators that bring rows together: line dedup, sharding, exact dedup, near-dedup, components; the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from setwise.llm import exact_dedup, line_dedup, near_dedup, sharding
from setwise.llm import shingles as sh
from setwise.llm.common import Scratch
from setwise.llm.components import components
from tests.llm.conftest import EN, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact dedup


@pytest.mark.parametrize("size,hash_of", [(4096, F.xxhash64), (7, F.xxhash64), (3, lambda c: F.pmod(F.xxhash64(c), F.lit(5))), (5, lambda c: F.lit(1).cast("bigint"))])
def test_exact_dedup_matches_brute_force(spark, size, hash_of):
    rnd = random.Random(size)
    texts = [None, "", "A", "a", "É", "é", "abc" * 9, "ABC" * 9] + ["".join(rnd.choice("abAé\n🙂") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(i if i % 11 else None, rnd.choice(texts)) for i in range(150)] + [(3, "abc"), (3, "abc"), (3, "ABC")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).persist()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, size=size, hash_of=hash_of).collect())
    assert got == want


def test_exact_dedup_survives_other_splits(spark, tmp_path, monkeypatch):
    """Ties among hashes, and every reading of the input cut differently, as after a change of executors."""
    rnd = random.Random(77)
    rows = [(i, "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    save, sizes = Scratch.save, ["1k", "128m", "4k"]
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"

    def saved(self, df, name="t"):
        spark.conf.set(key, sizes[0])
        sizes.append(sizes.pop(0))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    was = spark.conf.get(key), spark.conf.get(cost)
    spark.conf.set(cost, "1")
    try:
        got = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d")), size=2, hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(5))).collect()
    finally:
        spark.conf.set(key, was[0])
        spark.conf.set(cost, was[1])
    best, n = {}, Counter(t for _, t in rows)
    for i, t in rows:
        best[t] = max(i, best.get(t, -1))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((i, best[t], n[t]) for i, t in rows)


def test_block_names_follow_the_order(spark):
    """Names rise with (hash) or, where hashes tie, with (hash, content) below zero."""
    blocks = [f"t{i}" for i in range(300)]
    rows = spark.createDataFrame([(b, b) for b in blocks], "k string, text string").repartition(5)
    named = exact_dedup.block_identities(Scratch(spark, "t"), rows, "text", ["k"])
    got = [r["k"] for r in named.withColumn("h", F.xxhash64("k")).orderBy("name").collect()]
    assert got == [r["k"] for r in rows.orderBy(F.xxhash64("k")).collect()]
    named = exact_dedup.block_identities(Scratch(spark, "t"), rows, "text", ["k"], hash_of=lambda c: F.lit(1).cast("bigint"))
    assert [r["k"] for r in named.orderBy(F.desc("name")).collect()] == sorted(blocks)


def test_exact_dedup_on_odd_rows(odd_docs, no_docs):
    assert exact_dedup.exact_dedup(odd_docs, size=1000).count() == odd_docs.count()
    assert exact_dedup.exact_dedup(no_docs).count() == 0


# line dedup


def brute_lines(rows, min_sites):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if (t := line.strip(line_dedup.EDGE)) and source is not None:
                sites[t].add(source)
    shared = {t for t, s in sites.items() if len(s) >= min_sites}
    out = Counter()
    for doc_id, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        trimmed = [x.strip(line_dedup.EDGE) for x in lines]
        n, n_lines = sum(t in shared for t in trimmed), sum(t != "" for t in trimmed)
        clean = text if not n else "\n".join(x for x, t in zip(lines, trimmed) if t not in shared)
        out[(doc_id, n_lines, n, 0 < n == n_lines, clean)] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 4, 10])
def test_line_dedup_matches_brute_force(spark, min_sites):
    rnd = random.Random(min_sites)
    common = [f"footer {i}" for i in range(12)] + ["  padded \t", "padded", ""]
    rows = []
    for i in range(200):
        lines = [rnd.choice(common) if rnd.random() < 0.4 else f"own {i} {j} " + "word " * rnd.randint(0, 9) for j in range(rnd.randint(0, 8))]
        rows.append((i if i % 13 else None, "\n".join(lines) if i % 17 else None, f"s{rnd.randint(0, 14)}" if i % 19 else None))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, source string")
    got = Counter((r["doc_id"], *r["lines"]) for r in line_dedup.remove_boilerplate(docs, min_sites).select("doc_id", "lines").collect())
    assert got == brute_lines(rows + rows[:5], min_sites)


def test_line_dedup_on_odd_rows(odd_docs, no_docs):
    out = line_dedup.line_stage(None, odd_docs, "")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert line_dedup.remove_boilerplate(no_docs).count() == 0


def test_line_dedup_keeps_every_column(spark):
    """Also those that are called like the operator's own, and a column called like the result is replaced."""
    rows = [(i, f"own {i}\nfooter", f"s{i}", "k", "s", "n", "o", "r", "x") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __key string, shared string, n_lines string, own string, r string, lines string")
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[3:8] for r in out.collect()} == {("k", "s", "n", "o", "r")} and {r["lines"]["text"] for r in out.collect()} == {f"own {i}" for i in range(12)}


def test_line_stage_removes_boilerplate_of_any_share(spark):
    """All but texts without a line of their own lose it, be it most of the text."""
    licence = "\n".join(f"clause {i} of a licence found on every site " + "and so on " * 20 for i in range(3))
    rows = [(i, f"own words of page {i}\n{licence}", f"s{i}", -1) for i in range(12)]  # about 97% boilerplate
    rows += [(50, licence, "s1", -1), (51, f"\n{licence}\n ", "s2", -1), (52, "own only", "s3", -1), (53, None, "s4", None), (54, f"{licence}\n{licence}\nx", None, -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    found = {r["doc_id"]: (r["lines"]["text"], r["lines"]["none_own"]) for r in line_dedup.remove_boilerplate(docs).collect()}
    assert found[50] == ("", True) and found[51] == ("\n ", True) and found[54] == ("x", False) and found[3] == ("own words of page 3", False)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.line_stage(spark, docs, "").collect()}
    want = {i: (f"own words of page {i}", len(f"own words of page {i}")) for i in range(12)}
    assert got == want | {50: (licence, -1), 51: (f"\n{licence}\n ", -1), 52: ("own only", -1), 53: (None, None), 54: ("x", 1)}


# sharding


def test_shards_are_even_and_gapless(spark):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.randint(0, 300) + str(i), rnd.choice(["en", "fr", None]), "hot" if rnd.random() < 0.4 else f"s{i % 9}") for i in range(3000)]
    rows += [(1, "same", "en", "hot")] * 1500  # a third of all rows alike
    rows += [(10_000 + i, "two" * (i // 2), f"l{i % 2}", f"s{i % 7}") for i in range(60)]  # copies on different sites
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t) + 16, zlib.crc32(t.encode())) for i, t, *_ in rows)
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append((r["slot"], r["size"]))
    assert sorted(shards) == list(range(40))
    weights = [sum(s for _, s in v) for v in shards.values()]
    # a group of up to 1/32 of a shard is one point; each of six cuts is off by half of one at most
    assert max(weights) - min(weights) <= 0.1 * sum(weights) / 40 + 4 * 320
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in shards.values())
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    where = defaultdict(set)
    for r in out:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    split = [k for k, v in where.items() if len(v) > 1]
    assert len(split) <= 39 and (zlib.crc32(b"same"), 20) in split


def brute_tree(points, extents, first, leaves):
    """point -> leaf by sorting, weighing and cutting; points: (coordinates, tie, weight)."""
    if leaves == 1 or not points:
        return {p: first for p in points}
    spread = [(max(p[0][d] for p in points) - min(p[0][d] for p in points)) / e for d, e in enumerate(extents)]
    dim = spread.index(max(spread))
    goal, before, cut = sum(p[2] for p in points) * (leaves // 2) / leaves, 0, 0
    ordered = sorted(points, key=lambda p: (p[0][dim], p[1]))
    for cut, p in enumerate(ordered):
        if before + p[2] > goal:
            cut += goal - before >= p[2] / 2
            break
        before += p[2]
    half = leaves // 2
    return brute_tree(ordered[:cut], extents, first, half) | brute_tree(ordered[cut:], extents, first + half, leaves - half)


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_tree_matches_brute_force(spark, shards):
    rnd = random.Random(shards)
    rows = [(i, float(rnd.randint(0, 30)), rnd.random(), rnd.choice([0.0, 0.5]), rnd.randint(1, 90), i if i % 5 else -1 - i // 10) for i in range(1500)]
    table = spark.createDataFrame(rows, "id bigint, a double, b double, c double, weight int, grp bigint").repartition(3)
    got = {r["id"]: (r["shard"], r["grp"]) for r in sharding.kd_shards(table, ["a", "b", "c"], "weight", "grp", ["id"], shards, precision=0.0).collect()}
    tie = {r["grp"]: r["t"] for r in table.select("grp", F.shiftleft(F.shiftrightunsigned(F.xxhash64("grp"), 31), 20).alias("t")).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[5]].append(r)
    most = sharding.GROUP_SHARE * sum(r[4] for r in rows) / shards
    points, of = [], {}
    for g, own in groups.items():
        weight = sum(r[4] for r in own)
        if shards < 40:
            assert weight <= most
        point = (tuple(min(r[d] for r in own) for d in (1, 2, 3)), tie[g], weight)
        points.append(point)
        of[g] = point
    if shards == 40:  # many groups are heavier: only shares of a leaf are compared
        weights = Counter()
        for r in rows:
            weights[got[r[0]][0]] += r[4]
        assert max(weights.values()) - min(weights.values()) < 0.4 * sum(weights.values()) / 40 + 180
        return
    extents = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in (1, 2, 3)]
    leaf = brute_tree(points, extents, 0, shards)
    assert {i: s for i, (s, _) in got.items()} == {r[0]: leaf[of[r[5]]] for r in rows}


def test_shards_by_target_bytes_and_odd_rows(odd_docs, no_docs, spark):
    assert sharding.shard_documents(odd_docs).count() == odd_docs.count()
    small = odd_docs.where("doc_id >= 100")
    total = sharding.shard_documents(small).agg(F.sum("size")).first()[0]
    out = sharding.shard_documents(small, shards=None, target_bytes=total // 5 + 1)
    assert out.count() == 60 and {r["shard"] for r in out.select("shard").distinct().collect()} == set(range(5))
    assert sharding.shard_documents(no_docs).count() == 0
    assert sharding.shard_documents(odd_docs, shards=1).select("shard").distinct().count() == 1
    names = ["doc_id", "text", "lang", "source", "shard", "slot", "size", "first", "number", "w", "pid", "node", "dim"]
    clash = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", *["x"] * 9) for i in range(50)], ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    assert Counter(r["doc_id"] for r in sharding.shard_documents(clash, shards=4).collect()) == Counter(range(50))
    long = spark.createDataFrame([(i, "y" * 40_000 if i == 0 else f"text {i}", "en", f"s{i % 3}") for i in range(400)], "doc_id bigint, text string, lang string, source string")
    sizes = Counter()
    for r in sharding.shard_documents(long, shards=8).collect():
        sizes[r["shard"]] += r["size"]
    rest = sorted(sizes.values())[:-1]
    assert max(sizes.values()) >= 40_016 and len(sizes) >= 2 and max(rest) < 40_000


# near-dedup


def brute_near(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        names[root] = min((x for x in (names.get(root), doc_id) if x is not None), default=None)
    return Counter((doc_id, len(sets[i]), names[find(i)], doc_id == names[find(i)]) for i, (doc_id, _) in enumerate(rows))


def near_rows():
    rnd = random.Random(21)
    vocabulary = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (None, "lonely text with no name here"), (None, None), (8, "one two three four five")]
    at = 100
    for size in (2, 3, 8, 60):
        base = prose(size, vocabulary, rnd.choice([40, 150, 900, 1500])).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, len(base) // 28)):
                words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
            rows.append((at, " ".join(words)))
            at += 1
    passage = prose(77, vocabulary, 60)
    rows += [(at + i, prose(1000 + i, vocabulary, 40) + " " + passage) for i in range(60)]
    return rows + [rows[12], rows[12]]


def test_near_dedup_matches_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).persist()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect())
    want = brute_near(rows)
    fix = lambda c: Counter({(a, b, n, a == n): v for (a, b, n, _), v in c.items()})  # noqa: E731  null names itself
    assert fix(got) == fix(want)


def test_near_dedup_on_odd_rows(odd_docs, no_docs):
    out = near_dedup.near_stage(None, odd_docs, "")
    assert out.columns == odd_docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 8 not in ids and 9 in ids and 11 not in ids and ids.count(1) == 1
    assert near_dedup.near_components(no_docs.select("doc_id", "text")).count() == 0


def test_odd_sketch_bounds_the_difference():
    import numpy as np

    rnd = random.Random(8)
    both = sorted({rnd.getrandbits(64) for _ in range(9000)})
    for n in (500, 500, 1500, 3000, 6000) * 8:
        one = np.array(sorted(rnd.sample(both, n)), np.uint64)
        keep = rnd.sample(one.tolist(), int(n * rnd.uniform(0.76, 1)))
        two = np.array(sorted(set(keep) | set(rnd.sample(both, n // 12))), np.uint64)
        a, b = (sh.odd_sketch(s, sh.level_of(len(s))) for s in (one, two))
        assert len(a) * 64 >= n
        if len(a) > len(b):
            a = sh.folded(a)
        elif len(b) > len(a):
            b = sh.folded(b)
        assert len(a) == len(b)
        flips = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        differ = len(set(one.tolist()) ^ set(two.tolist()))
        assert flips <= differ and (differ - flips) % 2 == 0 and flips > 0.55 * min(differ, 32 * len(a))
        assert (sh.folded(sh.odd_sketch(one, 3)) == sh.odd_sketch(one, 2)).all()


def long_rows():
    """Texts of 900 to 5,000 shingles, in pairs just over and just under the threshold, across levels of the sketch."""
    rnd, rows, at = random.Random(31), [], 0
    for n in (900, 1020, 1100, 1900, 2040, 2200, 3000, 4090, 4500, 5000):
        for drop in (0.10, 0.135, 0.16, 0.24):  # J = 0.82, 0.76, 0.72, 0.61 with whole words replaced at one end
            words = [f"n{at}w{i}" for i in range(n + 4)]
            cut = int(n * drop)
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[cut:] + [f"o{at}w{i}" for i in range(cut)]))]
            # and one that is shorter by as much as a link allows, so that levels differ
            rows.append((at + 2, " ".join(words[int(n * rnd.choice([0.2, 0.245, 0.27])) :])))
            at += 3
    return rows


def test_long_texts_match_brute_force(spark):
    rows = long_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).persist()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect())
    want = brute_near(rows)
    assert got == want
    assert 20 < sum(k[3] for k in want) < len(rows) - 20  # links and near misses


def test_open_buckets_of_any_layout(spark, monkeypatch):
    """Unlike texts around a shared passage, near copies whose first member is an outlier, leaders and tiles of every size."""
    rnd = random.Random(5)
    words = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):  # similarities from 0.4 to 0.8 around one passage
        tail = [f"t{i}x{j}" for j in range(rnd.choice([4, 10, 16, 24]))]
        rows.append((1000 + i, " ".join(words + tail)))
    base = [f"c{i}" for i in range(100)]
    rows.append((0, " ".join(base[:50] + [f"q{i}" for i in range(12)] + base[62:])))
    rows += [(1 + i, " ".join(base[: 99 - i % 3] + [f"z{i}"])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).persist()
    want = brute_near(rows)
    for tile, size, rounds in ((7, 10, 2), (4000, 1000, 0)):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        monkeypatch.setattr(near_dedup, "LEADER_SIZE", size)
        monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(near_dedup, "LEADER_PAIRS", 0)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect())
        assert got == want, (tile, size, rounds)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rnd = random.Random(1)
    rnd.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from setwise.llm import language_id, packing, quality_rules
    import public_tokenizers

    rows = [(i, t, "en", f"s{i % 12}", 0) for i, t in near_rows() if i is not None and i != 4]
    rows += [(5000 + i, f"{prose(3000 + i, EN, 50)} {i}\nshared footer line", "en", f"s{i % 12}", 0) for i in range(24)]
    rows += [(6000, "again and again and " * 40, "en", "s1", 0), (6001, "12 34 56 78 90 12 34 56 78 90 1 2 3", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if quality_rules.verdict(quality_rules.measure(r[1]))[1]]
    model = language_id.fit(spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    kept = [r for r in kept if not language_id.classify(model, r[1])[3]]
    cleaned = brute_lines([(r[0], r[1], r[3]) for r in kept], line_dedup.MIN_SITES)
    whole = dict((r[0], r[1]) for r in kept)
    texts = [(k[0], whole[k[0]] if k[3] else k[4]) for k, n in cleaned.items() for _ in range(n)]
    assert any(k[2] for k in cleaned), "no line was removed"
    alive = {k[0] for k in brute_near(texts) if k[3]}
    assert len(alive) < len({i for i, _ in texts})
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts:
        if i in alive:
            for j, (start, length) in enumerate(packing.cut(len(own.ids(text)) + 1, 1024)):
                want[(i, j, start, length)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in pieces) == want
