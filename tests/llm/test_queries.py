"""The registered queries themselves, over a small folder of tables: DuckDB where there is SQL, else brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from setwise.llm import packing, queries
from tests.llm.conftest import EN, FR, prose
from tests.llm.test_row_operators import brute_quality
from tests.llm.test_shuffle_operators import brute_near

TALK = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "a\\b <|im_end|> c"), (2, 0, "system", "be brief"), (2, 1, "user", "</s>"), (2, 2, "assistant", ""),
    (3, 1, "assistant", "late"), (3, 0, "user", "x" * 5000), (4, 0, None, None), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "assistant", "no turn"),
]


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    more = [(500 + i, prose(i % 9, EN, 40) + f"\nfooter of all sites\nown line {i}", "en", f"site{i % 12}", i) for i in range(40)]
    more += [(600 + i, prose(50 + i, FR, 80), "fr", "s1", i) for i in range(20)] + [(700, "½ ²", "en", "s1", 3)]
    docs = odd_docs.where("doc_id is not null and doc_id <> 7 and doc_id <> 9").select("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100, 130)] + [(i, 0, 1) for i in range(200, 230)] + [(100, 1, 0), (None, 1, 0), (3, None, None), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(TALK, "conv_id bigint, turn int, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def got(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    rows = got(spark, folder, name)
    columns = sorted(rows[0])
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(want)


def test_op1_language(spark, folder, docs):
    rows = got(spark, folder, "op1_language_id")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    text = dict(docs)
    for r in rows:
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("en", "fr", "und")
    prose_rows = [r for r in rows if r["held_out"] and 100 <= r["doc_id"] < 700]
    assert len(prose_rows) > 10 and all(r["lang_pred"] == ("fr" if 200 <= r["doc_id"] < 300 or r["doc_id"] >= 600 else "en") for r in prose_rows)


def test_op3_sharding(spark, folder, docs):
    rows = got(spark, folder, "op3_sharding")
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == want
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(v) > 1 for v in where.values()) <= 39


def test_op5_near_dedup(spark, folder, docs):
    rows = got(spark, folder, "op5_near_dedup")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == brute_near(docs)


def test_op6_quality_rules(spark, folder, docs):
    want = Counter(tuple(sorted((brute_quality(t) | {"doc_id": i}).items())) for i, t in docs)
    assert Counter(tuple(sorted(r.items())) for r in got(spark, folder, "op6_quality_rules")) == want


def test_op7_packing(spark, folder, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, want, places = got(spark, folder, "op7_best_fit_packing"), Counter(), defaultdict(list)
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for n, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[(i, n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    short = Counter(k[3] for k in want.elements() if k[3] < 1024)
    assert len(places) == sum(k[3] == 1024 for k in want.elements()) + packing.plan(short, 1024)[1]


def test_op8_quality(spark, folder, docs):
    rows = got(spark, folder, "op8_quality_classifier")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and 100 <= r["doc_id"] < 230]
    assert len(held) > 5 and all(r["predicted"] == (r["doc_id"] < 200) for r in held)


def test_op9_probe_conversation(spark, folder):
    rows = {r["conv_id"]: r for r in got(spark, folder, "op9_chat_formatting")}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_chars"] == len(said)
    assert rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert set(rows) == {-7, 1, 2, 3, 4, 5, 6} and rows[5]["n_turns"] == 2


def test_op10_codec(spark, folder, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha, want = lambda s: hashlib.sha256(s.encode()).hexdigest(), Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got(spark, folder, "op10_bpe_codec")) == want
