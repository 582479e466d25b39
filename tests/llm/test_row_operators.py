"""Operators that judge each row on its own: language ID, quality rules, quality classifier, BPE codec."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from setwise.llm import bpe, compression, language_id, quality_classifier, quality_rules
from setwise.llm.common import Scratch, held_out
from tests.llm.conftest import EN, FR, prose


# quality rules


def brute_quality(text):
    """Every figure of the operator, from the words and windows themselves."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))
    covered = {}
    for n in (5, 7, 10):
        windows = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered[n] = {j for i in range(len(words) - n + 1) if windows[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            dup += line in seen
            dup_chars += sum(map(len, own)) if line in seen else 0
            seen.add(line)
    share = lambda part: part / chars if chars else 0.0
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(covered[5])}
    out |= {"dup_line_coverage": share(dup_chars)} | {f"coverage_{n}": share(sum(len(words[j]) for j in covered[n])) for n in (5, 7, 10)}
    out["base_failed"] = len(words) < 10 or 100 * len(covered[5]) > 20 * len(words)
    limits = {"coverage_5": 0.25, "coverage_7": 0.22, "coverage_10": 0.20, "dup_line_coverage": 0.30}
    out["kept"] = not out["base_failed"] and all(out[k] <= v for k, v in limits.items())
    return out


def test_quality_measures_match_brute_force():
    rnd = random.Random(3)
    texts = [None, "", " ", "a b c d e a b c d e", "x\nx\n\n\nx", "é 中文 é 中文 é #|", "a\x1cb c d"]
    texts += ["".join(rnd.choice(["a", "b", " ", " ", "\n", "\t", "é", "#", "\x0b"]) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    passage = prose(8, EN, 14)
    texts += [" ".join(rnd.choice([passage, f"x{rnd.randint(0, 10**6)}", "own line\nown line\n"]) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    long_words = " ".join("w" * 30 + str(i) for i in range(5))  # few repeated words, many repeated characters
    texts += [f"{long_words} {prose(i, 'a b c d e f g h', 3)} {' '.join(f'x{j}' for j in range(50 + i))} {long_words}" for i in range(10)]
    found = Counter()
    for text in texts:
        m = quality_rules.measure(text)
        m["base_failed"], m["kept"] = quality_rules.verdict(m)
        assert m == brute_quality(text), text
        found[m["base_failed"], m["kept"]] += 1
    assert len(found) == 3, found  # the method's own verdict matters too


@pytest.mark.parametrize("n", [1, 5, 10])
def test_hashes_roll(n):
    """Equal windows have equal hashes wherever they stand, and the hash is the polynomial of the window."""
    rnd = np.random.default_rng(n)
    ids = rnd.integers(0, 3, 3000)
    hashes = quality_rules.rolling_hashes(ids, n)
    x, m = quality_rules._mixed(ids), int(quality_rules._MULTIPLIER)
    for i in (0, 1, 17, 2990):
        assert int(hashes[i]) == sum(int(x[i + j]) * m**j for j in range(n)) % 2**64
    by_window = {}
    for i, h in enumerate(hashes.tolist()):
        assert by_window.setdefault(tuple(ids[i : i + n]), h) == h
    assert len(set(by_window.values())) == len(by_window)


def test_hash_collisions_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(quality_rules, "rolling_hashes", lambda ids, n: np.zeros(len(ids) - n + 1, np.uint64))
    ids = np.array([0, 1, 2, 3, 4, 9, 0, 1, 2, 3, 4, 8, 7])
    assert quality_rules.repeated_mask(ids, 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False, False]


def test_quality_keeps_clean_and_drops_repetition():
    clean, looped = prose(1, " ".join(f"w{i}" for i in range(500)), 300), "same five words over again " * 30
    assert quality_rules.verdict(quality_rules.measure(clean)) == (False, True)
    assert quality_rules.verdict(quality_rules.measure(looped)) == (True, False)
    assert quality_rules.verdict(quality_rules.measure(None)) == (True, False)


def test_quality_on_odd_rows(odd_docs, no_docs, odd_rows):
    out = quality_rules.repetition_coverage(odd_docs)
    assert out.columns == [*odd_docs.columns, "quality"]
    got = Counter((r["doc_id"], tuple(sorted(r["quality"].asDict().items()))) for r in out.select("doc_id", "quality").collect())
    assert got == Counter((r[0], tuple(sorted(brute_quality(r[1]).items()))) for r in odd_rows)
    assert quality_rules.repetition_coverage(no_docs).count() == 0
    kept = quality_rules.quality_stage(None, odd_docs, "")
    assert kept.columns == odd_docs.columns
    assert {1, 2, 3, 4} & {r["doc_id"] for r in kept.select("doc_id").collect()} == set()


# language ID


def test_language_accuracy_and_rejection(odd_docs, no_docs):
    model = language_id.fit(odd_docs, ~held_out(F.col("doc_id")))
    assert set(model.contents) == {"en", "fr"}
    rows = language_id.identify(odd_docs, model).select("doc_id", "lang", "language").collect()
    assert len(rows) == odd_docs.count()
    prose_rows = [r for r in rows if r["doc_id"] and r["doc_id"] >= 100]
    assert all(r["language"]["lang"] == r["lang"] and not r["language"]["rejected"] for r in prose_rows)
    for r in rows:
        assert 0 <= r["language"]["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 14):
            assert r["language"]["lang"] == "und" and r["language"]["rejected"]
    empty = language_id.fit(no_docs)
    assert empty.contents == {} and language_id.classify(empty, EN) == ("und", 0.0, 0.0, True)
    assert language_id.identify(no_docs, empty).count() == 0


def test_language_ties_are_rejected_and_ordered():
    model = compression.model_of({"b": EN.encode(), "a": EN.encode()})
    lang, _, margin, rejected = language_id.classify(model, EN)
    assert (lang, margin, rejected) == ("a", 0.0, True)


def test_sample_is_bounded_and_hot_label_safe(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("lang"), F.concat(F.lit("t"), F.col("id") % 7000).alias("text"))
    sample, counts = compression.bounded_sample(Scratch(spark, "test"), rows, "lang", F.col("text"), ["text"], 50)
    found = sample.collect()
    assert counts == {"hot": 18_000, "cold": 2_000}
    assert Counter(r["label"] for r in found) == {"hot": 50, "cold": 50} and len({(r["label"], r["text"]) for r in found}) == 100
    assert sorted(r["rank"] for r in found if r["label"] == "hot") == list(range(1, 51))
    smallest = rows.where("lang = 'hot'").select("text", (F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))).alias("u")).distinct().orderBy("u").limit(50)
    assert {r["text"] for r in found if r["label"] == "hot"} == {r["text"] for r in smallest.collect()}


def test_language_of_copies_only_is_learned(spark):
    """180,000 rows over 18 texts beside 20,000 texts: both languages keep their samples."""
    one, two = (F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") % m).cast("string")) for w in words.split()]) for words, m in ((FR, 18), (EN, 20_000)))
    hot = spark.range(180_000).select(F.lit("hot").alias("lang"), one.alias("text"))
    rows = hot.unionByName(spark.range(20_000).select(F.lit("cold").alias("lang"), two.alias("text")))
    sample, counts = compression.bounded_sample(Scratch(spark, "test"), rows, "lang", F.col("text"), ["text"], 800)
    assert Counter(r["label"] for r in sample.collect()) == {"hot": 18, "cold": 800} and counts["hot"] == 180_000
    model = language_id.fit(rows)
    assert set(model.contents) == {"hot", "cold"}
    assert language_id.classify(model, FR)[0] == "hot" and language_id.classify(model, EN)[0] == "cold"


def test_forty_languages(spark, monkeypatch):
    """More compressors than a worker keeps: the same answers."""
    words = [" ".join("".join(random.Random(i * 100 + j).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(40)) for i in range(40)]
    rows = [(f"l{i:02d}", prose(10 * i + j, words[i], 60)) for i in range(40) for j in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.contents) == 40
    tests = [prose(7000 + i, words[i], 30) for i in range(40)]
    roomy = language_id.classify_all(model, tests)
    assert [r[0] for r in roomy] == [f"l{i:02d}" for i in range(40)]
    monkeypatch.setattr(compression, "READY_BYTES", 10_000)
    compression._ready.clear()
    assert language_id.classify_all(model, tests) == roomy and len(compression._ready) < 40


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(compression, "MOST_LABELS", 5)
    rows = spark.range(6).select(F.col("id").cast("string").alias("lang"), F.lit("text").alias("text"))
    with pytest.raises(ValueError):
        language_id.fit(rows)


def test_excerpt_takes_pieces_from_all_over():
    assert compression.excerpt("short", 10) == "short"
    text = "".join(chr(0x4E00 + i) for i in range(1000))
    parts = compression.excerpt(text, 40).split("\n")
    assert len(parts) == 4 and all(len(p) == 10 and p in text for p in parts)
    assert text.startswith(parts[0]) and text.endswith(parts[3]) and 300 < text.index(parts[1]) < 350


def test_numerals_are_no_letters():
    model = compression.model_of({"a": EN.encode(), "b": FR.encode()})
    for text in ("½", "² ①", "123 ١٢", "!?", "́", "Ⅷ"):
        assert language_id.classify(model, text)[0] == "und", text
    for text in ("a", "ª", "ʰ", "中", "½x"):
        assert language_id.classify(model, text)[0] != "und", text


def brute_language(model_texts, text):
    """Plain compression against dictionaries of the whole texts, in the order of the sample."""
    import unicodedata

    import zstandard

    def words(t):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()

    raw = " ".join(words(text or "")).encode()
    if not raw:
        return "und", 0.0
    sizes = {}
    for lang, texts in model_texts.items():
        content = "\n".join(" ".join(words(t)) for t in texts).encode()
        made = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(made.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    best = min(sizes, key=lambda k: (sizes[k], k))
    return best, 1 / (1 + sum(np.exp(-(v - sizes[best]) / 8) for k, v in sizes.items() if k != best))


def test_language_matches_brute_force(spark):
    rows = [(i, prose(i, EN if i % 3 else FR, 10 + i % 100), "en" if i % 3 else "fr") for i in range(120)] + [(500, None, "en"), (501, "42", None), (502, "", "fr"), (503, EN * 20, None)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    order = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)).alias("u")).distinct().orderBy("u").collect()
    texts = {k: [r["text"] for r in order if r["lang"] == k] for k in ("en", "fr")}
    texts = {k: [t if len(language_id.letters(t)) <= 1000 else None for t in v] for k, v in texts.items()}
    assert None not in texts["en"] + texts["fr"]
    for r in language_id.identify(docs, model).select("text", "language.*").collect():
        lang, score = brute_language(texts, r["text"])
        assert r["lang"] == lang and abs(r["score"] - score) < 1e-9


# quality classifier


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rnd = random.Random(5)
    good = [(i, prose(i, EN + " " + FR, 80), 1) for i in range(400)]
    bad = [(1000 + i, " ".join("".join(rnd.choice("XYZ#$%") for _ in range(6)) + "!!" for _ in range(60)), 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_classifier_holds_out_and_separates(labelled, no_docs):
    docs, labels = labelled
    model = quality_classifier.fit(docs, labels, ~held_out(F.col("doc_id")))
    rows = quality_classifier.score(docs, model).join(labels.where("quality is not null"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert all((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows)
    assert model.score(None) == model.score("") == model.prior


def test_classifier_learns_both_classes_from_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "DICTIONARY_TEXTS", 10)
    monkeypatch.setattr(quality_classifier, "CALIBRATION_TEXTS", 10)
    rows = [(i, prose(i, FR if i % 2 else EN, 30)) for i in range(80)]
    docs = spark.createDataFrame(rows + rows + [(0, "hot " * 9)] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    model = quality_classifier.fit(docs, labels)
    assert set(model.sizes.contents) == {"0", "1"} and {len(v.split(b"\n")) for v in model.sizes.contents.values()} == {10}
    assert model.score(prose(901, FR, 30)) > 0.5 > model.score(prose(902, EN, 30))


def test_repeated_documents_and_labels_change_nothing(labelled):
    docs, labels = labelled
    once = quality_classifier.fit(docs, labels)
    many = quality_classifier.fit(docs.unionByName(docs).unionByName(docs.where("doc_id < 50")), labels.unionByName(labels))
    assert (many.sizes.contents, many.prior) == (once.sizes.contents, once.prior)
    assert abs(many.slope - once.slope) < 1e-9 and abs(many.intercept - once.intercept) < 1e-9


def test_classifier_scores_match_plain_compression(labelled):
    """The feature and the calibrated score of every text, from zstandard itself."""
    import zstandard

    docs, labels = labelled
    model = quality_classifier.fit(docs, labels)
    made = {
        k: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        for k, v in model.sizes.contents.items()
    }
    size = lambda k, raw: sum(len(made[k].compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    for r in quality_classifier.score(docs, model).collect():
        raw = r["text"].encode()
        x = (size("0", raw) - size("1", raw)) / len(raw)
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * x + model.intercept)))) < 1e-9


def test_classifier_without_labels_or_one_class(labelled, no_docs, odd_docs):
    docs, labels = labelled
    none = quality_classifier.fit(docs, labels.where("false"))
    assert none.score("anything") == 0.5
    one = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert one.score("anything") == 1.0
    assert quality_classifier.score(no_docs, none).count() == 0
    out = quality_classifier.score(odd_docs, quality_classifier.fit(docs, labels))
    assert out.count() == odd_docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0


# BPE codec

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["a", "b", "Z", "qx", "1", "'s", "'LL", "'", ".", "!!", " ", "\n", "\t", "\x1c", "\x85", "é", "ñ", "Σ", "İ", "ß", "ﬁ", "中", "🙂", "‍", "한", "ᆫ", "̧", "́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "</w>", "\x00", "½", "١", "the", "ing", "https://", "…", "ÀÉ", "÷", "ª"]


def test_codec_equals_library_on_random_texts():
    own, library = bpe.codec(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(11)
    for _ in range(4000):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        raw, decoded = own.encode_raw(text)
        assert own.encode(text) == ids == np.frombuffer(raw, "<i4").tolist(), repr(text)
        assert decoded.decode() == own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_other_files_are_left_to_the_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()  # no lower-casing
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    own, library = bpe.codec(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.codec(PATH).usual and not own.usual and not bpe.codec(byte_level).usual
    for codec, lib in ((own, library), (bpe.codec(byte_level), Tokenizer.from_file(byte_level))):
        for text in (None, "", "Words AND Ünicode 12's", "<|endoftext|> a"):
            ids = lib.encode(text or "", add_special_tokens=False).ids
            assert codec.encode(text) == ids and codec.encode_raw(text)[1].decode() == lib.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_exist_and_are_outside_tokens():
    own = bpe.codec(PATH)
    parts = own.cuts("aqzjb")
    assert len(parts) > 1 and "".join(parts) == "aqzjb"
    assert all(a[-1] + b[0] not in own.inside for a, b in zip(parts, parts[1:]))


def test_codec_on_odd_rows(odd_docs, no_docs, odd_rows):
    library = Tokenizer.from_file(PATH)
    got = Counter((r["doc_id"], tuple(r["bpe"]["ids"]), r["bpe"]["decoded"]) for r in bpe.encode_decode(odd_docs, PATH).select("doc_id", "bpe").collect())
    want = Counter()
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_decode(no_docs, PATH).count() == 0
