import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from setwise.llm import chat, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(pieces, budget):
    by_sequence = defaultdict(list)
    for length, sequence, offset in pieces:
        by_sequence[sequence].append((offset, length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= budget
    return len(by_sequence)


def placements(hist, budget, **options):
    rows, bins = packing.plan(hist, budget, **options)
    ranks = defaultdict(list)
    for length, rank, n, *_ in rows:
        ranks[length] += range(rank, rank + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in hist.items() if v}
    return [(length, first + i, offset) for length, _, n, first, offset in rows for i in range(n)], bins


def brute_sum_of_squares(hist, budget):
    """Each piece in turn, longest first: every open bin is tried, and the whole sum of squares counted."""
    bins = []  # [gap, latest use, lengths]
    for at, length in enumerate(sorted(Counter(hist).elements(), reverse=True)):
        best = None
        gaps = Counter(b[0] for b in bins if b[0])
        for gap in sorted({b[0] for b in bins if b[0] >= length}):
            after = gaps + Counter()
            after[gap] -= 1
            if gap > length:
                after[gap - length] += 1
            total = sum(v * v for v in after.values())
            if best is None or total < best[0]:
                best = total, gap
        if best is None:
            bins.append([budget - length, at, [length]])
        else:
            own = max((b for b in bins if b[0] == best[1]), key=lambda b: b[1])
            own[0], own[1] = own[0] - length, at
            own[2].append(length)
    return Counter(tuple(b[2]) for b in bins)


def test_plan_matches_brute_force():
    for seed in range(8):
        rnd = random.Random(seed)
        top = rnd.choice([9, 40, 90])
        hist = dict(Counter(rnd.randint(1, top) for _ in range(250)))
        placed, bins = placements(hist, 100, runs=10**9)
        own = defaultdict(list)
        for length, own_bin, offset in placed:
            own[own_bin].append((offset, length))
        assert bins == check_places(placed, 100) == len(own)
        assert Counter(tuple(x for _, x in sorted(v)) for v in own.values()) == brute_sum_of_squares(hist, 100)


def test_sum_of_squares_is_close_to_the_bound():
    rnd = random.Random(1)
    hist = Counter(rnd.randint(1, 1023) for _ in range(3000))
    placed, bins = placements(hist, 1024)
    assert Counter(p[0] for p in placed) == hist
    assert check_places(placed, 1024) == bins
    assert bins <= 1.025 * sum(k * v for k, v in hist.items()) / 1024  # as many as best-fit decreasing takes


def best_fit_decreasing(hist, budget):
    count, bins = Counter(), 0
    for length in sorted(Counter(hist).elements(), reverse=True):
        gap = min((g for g, n in count.items() if n and g >= length), default=None)
        bins += gap is None
        gap = budget if gap is None else gap
        count[gap] -= gap < budget
        count[gap - length] += 1
        count[0] = 0
    return bins


def test_runs_cost_no_bins():
    """Runs instead of single pieces: as many bins as best-fit decreasing, and the plan hardly grows."""
    rnd = random.Random(2)
    few = Counter(rnd.choice([1, 7, 300, 511, 512, 900]) for _ in range(20_000))
    many = Counter(rnd.randint(1, 1023) for _ in range(20_000))
    for hist in (few, many):
        placed, bins = placements(hist, 1024)
        assert check_places(placed, 1024) == bins <= best_fit_decreasing(hist, 1024)
    for times in (1, 1000, 1_000_000):
        huge = {k: v * times for k, v in few.items()}
        rows, bins = packing.plan(huge, 1024)
        assert len(rows) < 6 * 3 * packing.RUNS * np.log(max(huge.values())) and bins <= times * best_fit_decreasing(few, 1024)
        slots = packing._slots(huge, rows)
        assert (slots.end_rank - slots.first_rank).sum() == sum(huge.values()) and len(slots) <= len(rows) + 6 * packing.SLOTS


def test_other_tokenizer_files_are_left_to_the_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefix.json").write_text(json.dumps(spec))
    own = packing.ByteTokenizer(str(tmp_path / "prefix.json"))
    assert own.fast is None and own.ids("word") == own.library.encode(" word", add_special_tokens=False).ids
    spec["pre_tokenizer"]["add_prefix_space"] = False
    spec["model"]["merges"][5], spec["model"]["merges"][9] = spec["model"]["merges"][9], spec["model"]["merges"][5]
    (tmp_path / "merges.json").write_text(json.dumps(spec))
    assert packing.ByteTokenizer(str(tmp_path / "merges.json")).fast is None


def test_tokenizer_paths_agree():
    own, library = packing.tokenizer(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(4)
    pool = ["the", " the", "é", "ß", " ", "  ", "\n", "\n\n", "1", "23", "'s", "'re", "!?", "<|endoftext|>", "中文", "🙂", " ", "\x85", "ing", "\t", "—", "ÀÉ"]
    assert own.fast is not None
    for _ in range(4000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 20)))
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.ids("a" * 5000 + " " * 5000) == library.encode("a" * 5000 + " " * 5000, add_special_tokens=False).ids


def test_pack_odd_rows(odd_docs, no_docs, odd_rows):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(odd_docs, PATH).collect()
    want = Counter()
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        for i, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[(r[0], i, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_places([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 1024)
    assert packing.pack(no_docs, PATH).count() == 0


def test_cut():
    assert packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


# chat


def test_escape_is_reversible_and_hides_control_strings():
    rnd = random.Random(6)
    pool = [*chat.CONTROL_STRINGS, "\\", "<", ">", "a", "|", "[", "]", "/", "s", "\n", "<s", "INST]"]
    for _ in range(5000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 10)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL_STRINGS), (text, hidden)


def bracketed(turns):
    return "<s>" + "".join(f"[INST]{r}: {t}[/INST]" if r == "user" else f" {r}: {t}</s>" for r, t in turns)


def read(template, turns):
    formatted, back, rewrites, alters = chat.format_conversation(turns, template)
    return [(t["role"], t["text"], t["loss"]) for t in back], rewrites, alters


def test_spans_and_mask_of_any_template():
    turns = [("user", "AB"), ("assistant", ""), ("user", "B"), ("assistant", "AxB"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "\\")]
    for template in (chat.chatml, bracketed):
        escaped = [(r, chat.escape(t)) for r, t in turns]
        done = chat.render(template, escaped)
        assert done.output == template(escaped) and not done.rewrites_history and not done.alters_content
        assert [done.output[t.start : t.end] for t in done.turns] == [t for _, t in escaped]
        assert done.spans[-1][1] == len(done.output) and [a for a, _ in done.spans[1:]] == [b for _, b in done.spans[:-1]]
        assert read(template, turns) == ([(r, t, r == "assistant") for r, t in turns], False, False)


def test_templates_that_alter_content_are_flagged():
    trims = lambda turns: "".join(f"<{r}>{t.strip()}</{r}>" for r, t in turns)
    turns = [("user", "  yo \n"), ("assistant", "fine")]
    assert read(trims, turns) == ([("user", "yo", False), ("assistant", "fine", True)], False, True)
    assert read(trims, [("user", "yo"), ("assistant", "fine")])[2] is False
    hides = lambda turns: "".join(f"<{r}>{t}</{r}>" for r, t in turns if r != "system")
    assert read(hides, [("system", "quiet"), ("user", "a")]) == ([("user", "a", False)], False, True)
    nameless = lambda turns: "".join(f"{t}\n" for _, t in turns)
    assert read(nameless, [("user", "a"), ("assistant", "b")]) == ([("user", "a", False), ("user", "b", False)], False, True)


def test_templates_that_refuse_roles():
    def strict(turns):
        if any(r != ("user", "assistant")[i % 2] for i, (r, _) in enumerate(turns)):
            raise ValueError("roles must alternate")
        return "".join(f"<{r}>{t}\n" for r, t in turns)

    turns = [("user", "a"), ("assistant", "b"), ("user", "")]
    assert read(strict, turns) == ([("user", "a", False), ("assistant", "b", True), ("user", "", False)], False, False)


def test_rewriting_templates_are_detected():
    last_only = lambda turns: "".join(f"{r}:{t if i == len(turns) - 1 else t.split('|')[-1]};" for i, (r, t) in enumerate(turns))
    turns = [("assistant", "thought|word"), ("user", "next")]
    assert read(last_only, turns) == ([("assistant", "word", True), ("user", "next", False)], True, True)
    assert not chat.render(chat.chatml, turns).rewrites_history


def test_long_conversation_equals_full_rendering():
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(300)]
    want = [(r, t, r == "assistant") for r, t in turns]
    assert read(chat.chatml, turns) == (want, False, False)

    def counted(turns):  # a delta that depends on all earlier turns
        return "".join(f"{i}<{r}>{t}\n" for i, (r, t) in enumerate(turns))

    assert read(counted, turns) == (want, False, False)
    assert chat.render(counted, turns).output == counted(turns)


def test_late_rewrites_are_detected():
    """Templates that change earlier output only far back: every prefix is compared whole."""
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(300)]
    want = [(r, t, r == "assistant") for r, t in turns]
    keeps_last = lambda t: chat.chatml(t[-150:])
    assert read(keeps_last, turns) == (want[150:], True, True)
    strips_old = lambda t: chat.chatml([(r, x if i >= len(t) - 290 else "") for i, (r, x) in enumerate(t)])
    assert read(strips_old, turns) == (want[10:], True, True)
    only_now = lambda t: chat.chatml(t) if len(t) < 300 else chat.chatml(t).replace("text 0<", "text o<")
    assert read(only_now, turns)[1:] == (True, True)


def test_chats_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "</s>[INST]"), (3, 0, "user", "</s>[INST]"), (4, 0, "assistant", "L" * 300_000)]
    table = spark.createDataFrame([(*r, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for r in chat.format_chats(table).collect()}
    assert got == {1: [("user", "a", False), ("assistant", "b", True)], 2: [("", "", False)], None: [("user", "x", False), ("assistant", "y", True)], 3: [("user", "</s>[INST]", False)] * 2, 4: [("assistant", "L" * 300_000, True)]}
    assert chat.format_chats(table.where("false")).count() == 0
