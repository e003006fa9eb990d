import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.packing import WordTokenizer, best_pattern, configuration_lp, pack, pack_histogram

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "Don't WE'LL it's", "a\x1cb c\x85d", "é é ́x İI ß ΑΣ Σ", "tab\tnew\nline nbsp em", "<|endoftext|> x <|startoftext|>y", "123 4a5 ½ ٣", "日本語 テキスト", "🙂 a🙂b", "!!! ...'s 'S", "x'sy'LL ''d ß÷×ÿŸ ÀÉ", "a_b-c/d\\e\x00\x7f\x0b\x0cz", "µªº² don\u2019t"]


@pytest.mark.parametrize("text", ODD)
def test_words_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(WordTokenizer(PATH).ids(text), "<u4").tolist() == whole().encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(st.characters(max_codepoint=255), max_size=60))
def test_words_give_the_ids_of_any_text(text):
    assert np.frombuffer(WordTokenizer(PATH).ids(text), "<u4").tolist() == whole().encode(text, add_special_tokens=False).ids


def check(rows, got, capacity):
    t = whole()
    want = {}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.setdefault((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    have = {}
    by = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: len(v) for k, v in want.items()} == {k: len(v) for k, v in have.items()}
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in got)


def test_pack(documents):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "Quick", "fox-trot", "naïve", "x9"]) for _ in range(rng.choice((1, 5, 60, 700, 9000))))) for k in range(120)]
    rows += [(500, None), (501, ""), (7, "again"), (7, "again"), (None, "no id")]
    n, total = check(rows, pack(documents(rows), PATH).collect(), 4096)
    assert n <= 1.05 * total / 4096 + 1  # few kinds of lengths: plain best fit needs as many


def test_empty_table(documents):
    assert pack(documents([(1, "a")]).where("doc_id = 2"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_histograms_are_used_up_and_nearly_full(seed):
    rng = random.Random(seed)
    capacity = 512
    histogram = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(80)} | {capacity: 30}
    packed = pack_histogram(histogram, capacity)
    left = dict(histogram)
    for times, items in packed:
        assert times > 0 and sum(items) <= capacity
        for x in items:
            left[x] -= times
    assert not any(left.values())
    bound = -(-sum(x * n for x, n in histogram.items()) // capacity)
    big = sum(n for x, n in histogram.items() if 2 * x > capacity)  # no two of these share a sequence
    assert sum(t for t, _ in packed) <= 1.12 * max(bound, big) + 3
    assert sum(t for t, _ in packed) <= sum(t for t, _ in pack_histogram(histogram, capacity, 0))


def test_best_pattern_is_best():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(2, 30), 4)))
        price = np.array([rng.random() for _ in lengths])
        pattern = best_pattern(lengths, price, 40)
        worth = dict(zip(lengths.tolist(), price.tolist(), strict=True))

        def best(c):
            return max([worth[x] + best(c - x) for x in worth if x <= c], default=0.0)

        assert sum(x * k for x, k in pattern.items()) <= 40
        assert abs(sum(worth[x] * k for x, k in pattern.items()) - best(40)) < 1e-9


@pytest.mark.parametrize("most", [3, 400])
def test_patterns_cover_every_length(most):
    rng = random.Random(most)
    histogram = {x: rng.randint(1, most) for x in rng.sample(range(1, 513), 300)}
    covered = dict.fromkeys(histogram, 0)
    for use, pattern in configuration_lp(histogram, 512):
        assert use >= 1 and use == int(use) and sum(x * k for x, k in pattern.items()) <= 512
        for x, k in pattern.items():
            covered[x] += use * k
    assert covered == histogram


def test_added_tokens_have_their_own_ids(documents):
    plain = Tokenizer.from_file(PATH)
    texts = [*ODD, "a<|endoftext|>b", "<|startoftext|>", " <|endoftext|> <|ENDOFTEXT|> x<|endoftext|>", "日本<|endoftext|>語\x1c"]
    for text in texts:
        assert np.frombuffer(WordTokenizer(PATH).contract_ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack(documents(list(enumerate(texts))), PATH).collect()}
    for k, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_the_knapsack_takes_a_bit_for_each_item_and_room():
    import tracemalloc

    from lodestar.llm.packing import knapsack

    x = np.arange(1, 1600)
    tracemalloc.start()
    worth, taken = knapsack(x, x / 4096 * (1 + x / 8192), np.minimum(3, 4096 // x), 4096)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000  # 13 MB with a byte for each
    for room in (4096, 4095, 8, 7, 1):
        pattern = taken(room)
        assert sum(int(x[k]) * n for k, n in pattern.items()) <= room and all(n <= min(3, 4096 // x[k]) for k, n in pattern.items())
        assert abs(sum(x[k] / 4096 * (1 + x[k] / 8192) * n for k, n in pattern.items()) - worth[room]) < 1e-9


def test_many_texts_have_the_ids_of_each(monkeypatch):
    from lodestar.llm import packing

    plain, t, rng = Tokenizer.from_file(PATH), WordTokenizer(PATH), random.Random(5)
    texts = [None, *ODD, "a<|endoftext|>b", None, "", *(" ".join(rng.choice([*ODD, "12's 'sy'sy", "\xa0x\x85y", "e \u0301", "!!'re", "WE'VE\x1cIT'S"]) for _ in range(9)) for _ in range(60)), None]
    want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts, "this too"], pa.large_string()).slice(1, len(texts))):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in t.all_contract_ids(column)] == want
    monkeypatch.setattr(packing, "RUN_BYTES", 100)
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [row for out in packing._pieces(PATH, 50)(iter([batch, batch.slice(0, 0)])) for row in out.to_pylist()]
    parts = [(k, n, a, (ids + [1])[a : a + 50]) for k, ids in enumerate(want) for n, a in enumerate(range(0, len(ids) + 1, 50))]
    assert got == [{"doc_id": k, "piece": n, "start": a, "length": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())} for k, n, a, ids in parts]


def test_long_parts_are_not_remembered():
    t = WordTokenizer(PATH)
    for long in ("abc" * 4000, "日本語" * 4000):
        for _ in range(2):
            assert np.frombuffer(t.ids(f"short {long} words"), "<u4").tolist() == whole().encode(f"short {long} words", add_special_tokens=False).ids
    assert set(t.known) == {"short", "words"}


def test_units_cost_less_than_looking_each_up():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(8000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) + "." for _ in range(600)]
    t, column = WordTokenizer(PATH), pa.array(texts)
    units = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\r\x0b\x0c0-9a-z\xdf-\xf6\xf8-\xff]+")
    known = {unit: unit.encode() for text in texts for unit in units.findall(text)}

    def seconds(work):
        took = []
        for _ in range(4):  # the first meets every word
            begun = time.thread_time()
            work()
            took.append(time.thread_time() - begun)
        return min(took)

    together = getattr(t, "all_contract_ids", lambda texts: map(t.contract_ids, texts.to_pylist()))
    assert seconds(lambda: list(together(column))) < seconds(lambda: [b"".join(map(known.__getitem__, units.findall(text.lower()))) for text in texts])
