import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.mojibake import badness, mended, repaired

# --- mojibake

CLEAN = ["", "plain words", "naïve café, über Straße, señor, œuvre", "日本語 テキスト 🙂", "50 °C ± 3 µm ½ × ÷", "“quoted” – dash … €5 ™", "Ελλάδα Россия שלום", "Âge Ãos Ångström ÀÉÎÕÜ", "a b", "Ã ", "ß÷×ÿ"]


def wrong(text, table):
    """UTF-8 read by a table; bytes it has no character for become control characters."""
    raw = text.encode()
    if table == "latin-1":
        return raw.decode("latin-1")
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize("table", ("cp1252", "latin-1"))
def test_texts_come_back_whole(table):
    for text in CLEAN:
        assert mended(text) == text  # clean ones don't change
        once = wrong(text, table)
        assert mended(once) == text and mended(wrong(once, table)) == text
        assert badness(once) >= badness(text)
        assert mended(f"{text} | {once}") == f"{text} | {text}"


def test_columns(spark):
    df = spark.createDataFrame([(1, wrong("été à Zürich", "cp1252")), (2, None), (3, "ok"), (4, wrong("é" * 100_000, "latin-1"))], "id int, text string")
    got = {r.id: r.t for r in df.select("id", repaired(F.col("text")).alias("t")).collect()}
    assert got == {1: "été à Zürich", 2: None, 3: "ok", 4: "é" * 100_000}


# --- byte pairs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Don't WE'LL it's", "tab\tnew\nline", "123 4a5 ½ ٣", "日本語 テキスト", "🙂 a🙂b", "!!! ...'s 'S", "naïve café", "a_b-c/d\\e", "supercalifragilistic " * 3, "x" * 300, "the the the"]


@pytest.fixture(scope="module")
def pairs():
    from lodestar.operators.byte_pairs import BytePairs

    return BytePairs.from_file(PATH)


def test_ids_are_those_of_the_public_library(pairs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    rng = random.Random(1)
    words = ["the", "Quick", "fox-trot", "naïve", "x9", "It's", "(hello)", "unbelievable", "zzyzx", "12345", "Ω", "e-mail@site.com"]
    for text in ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]:
        assert pairs.encode(text) == whole.encode(text, add_special_tokens=False).ids, text


def test_merges_are_those_of_plain_rounds(pairs):
    """Lowest rank first, all of one kind from the left before the next: by scanning the word again for each merge."""

    def plain(word):
        part = [pairs.shown[b] for b in word.encode()]
        part[-1] += "</w>"
        while True:
            ranked = [(pairs.ranks[p], k) for k, p in enumerate(zip(part, part[1:])) if p in pairs.ranks]  # noqa: B905
            if not ranked:
                return part
            k = min(ranked)[1]
            part[k : k + 2] = [part[k] + part[k + 1]]

    rng = random.Random(2)
    for _ in range(400):
        word = "".join(rng.choice("aabcdehinorstté") for _ in range(rng.randrange(1, 14)))
        assert pairs._merged(word) == plain(word)


def test_round_trip_and_windows(pairs):
    for text in ODD:
        ids = pairs.encode(text)
        again = pairs.decode(ids)
        assert pairs.encode(again) == ids and again.replace(" ", "") == "".join(text.split()).lower()
    assert pairs.decode([pairs.special["<|startoftext|>"], *pairs.encode("hello there"), pairs.special["<|endoftext|>"]]).strip() == "hello there"
    window = pairs.window("hello there")
    assert len(window) == 77 and window[0] == 49406 and window[3] == 49407 and not any(window[4:])
    assert len(pairs.window("the " * 75)) == 77
    with pytest.raises(ValueError, match="too long"):
        pairs.window("the " * 76)
    assert pairs.window("the " * 99, cut=True)[-1] == 49407
    with pytest.raises(KeyError):
        pairs.decode([10**6])


def test_columns_of_ids(spark, pairs):
    from lodestar.operators.byte_pairs import byte_pair_ids, byte_pair_texts

    df = spark.createDataFrame([(1, "Hello THERE", "x"), (2, None, "x"), (3, "", "x")], "id int, text string, ids string").repartition(2)
    got = {r.id: (r.ids, r.decoded) for r in byte_pair_texts(byte_pair_ids(df, PATH), PATH).collect()}
    assert got[1] == (pairs.encode("hello there"), "hello there") and got[2] == got[3] == ([], "")
    with pytest.raises(Exception, match="too long"):
        byte_pair_ids(df, PATH, context=3).collect()
