import random
import subprocess
import sys

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from cuesheet.llm import bpe
from cuesheet.llm.queries import bpe_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = [
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Σ", "ς", "İ", "é", "é", "̀", " ", "\n", "\x1c", "\x85", " ", "'s", "'S",
    "'ll", "''", "1", "²", "½", "Ⅷ", "日", "本", "한", "🤷", "‍", "ẞ", "ß", "ﬁ", "!!", "a", "B", "the", "\x00", "_", "-", "ŉ", "͸", "\U0001e900",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(n)]


def test_words_and_merges_equal_the_library(library):
    m = bpe.Merger(PATH)
    for text in texts(3000):
        ids = [i for w in m.words(text) for i in m.merge(w)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_is_classed_like_the_library(library):
    m = bpe.Merger(PATH)
    points = [c for c in (*range(0x3000), *range(0x3000, 0x110000, 97)) if not 0xD800 <= c < 0xE000]
    found = library.encode_batch([f"a{chr(c)}b {chr(c)}" for c in points], add_special_tokens=False)
    for c, e in zip(points, found, strict=True):
        assert [i for w in m.words(f"a{chr(c)}b {chr(c)}") for i in m.merge(w)] == e.ids, hex(c)


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 7))) for _ in range(500)})
    lexicon = bpe.Lexicon(bpe.compile_words((w, [i, i + 1]) for i, w in enumerate(words)))
    others = [b"", b"zz", b"abcabcabca", words[0] + b"c" * 9]
    assert lexicon.numbers(words + others).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert [lexicon.ids[lexicon.offsets[i]] for i in range(len(words))] == list(range(len(words)))
    # as many states as there are distinct sets of continuations
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lexicon.accepting) == len(rests)
    assert bpe.Lexicon(bpe.compile_words([])).numbers([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("words", [0, 40, 1 << 18])
def test_documents_encode_and_decode_like_the_library(spark, library, words):
    rows = [None, "", *texts(60), "the cat sat " * 20_000, "the", "the", "x" * 3000]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(rows)], "doc_id long, text string, ids string, n long")
    lexicon = bpe.build_lexicon(df, PATH, words)
    encoded = bpe.encode(df, PATH, lexicon)
    assert encoded.columns == ["doc_id", "text", "n", "ids"]
    got = bpe.decode(encoded, PATH).collect()
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert len(got) == len(rows)


def test_decoding_takes_only_the_strings_of_the_tokens(spark):
    df = spark.createDataFrame([([1, 300, 49_000, -1, 10**9], 1), (None, 2), ([], 3)], "ids array<int>, n long").repartition(1)
    strings, text = bpe.token_strings(PATH), bpe.Merger(PATH).text
    assert strings.to_pylist() == [text.get(i) for i in range(len(strings))] and max(text) == len(strings) - 1
    got = {r.n: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: " ".join(text[i] for i in (1, 300, 49_000)), 2: None, 3: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_digests(df, PATH).count() == 0


def test_long_words_merge_like_the_library(library):
    m, rng = bpe.Merger(PATH), random.Random(9)
    for n in (1, 2, 7, 129, 3000):
        word = "".join(rng.choices("aaabetns", k=n))
        assert m.merge(word) == library.encode(word, add_special_tokens=False).ids
    assert sum(len(m.text[i].removesuffix(m.suffix)) for i in m.merge("ab" * 250_000)) == 500_000


def test_encodes_in_an_interpreter_that_has_loaded_nothing_else():
    code = (
        "import pyarrow as pa\nfrom cuesheet.llm import bpe\n"
        "b = pa.RecordBatch.from_pylist([{'text': 'x' * bpe.CHUNK_CHARS}, {'text': 'x' * bpe.CHUNK_CHARS}, {'text': None}])\n"
        "print([p.num_rows for p in bpe._chunks(b, 0)])"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "[1, 2]"
