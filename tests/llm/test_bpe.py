import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe
from lodestream.llm.lexicon import Lexicon, build

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_lexicon_round_trip(tmp_path):
    r = random.Random(1)
    words = sorted({bytes(r.choice(b"abcxyz\xc3\xa9") for _ in range(r.randint(0, 7))) for _ in range(3000)})
    ids = [[r.randrange(50000) for _ in range(r.randint(0, 4))] for _ in words]
    raw = build(words, ids)
    (tmp_path / "lexicon").write_bytes(raw)
    mapped = Lexicon(str(tmp_path / "lexicon"))
    assert len(mapped) == len(words)
    for w, i in zip(words, ids, strict=True):
        assert mapped.get(w) == i
    for _ in range(3000):
        w = bytes(r.choice(b"abcxyz") for _ in range(r.randint(0, 8)))
        assert (mapped.get(w) is None) == (w not in set(words))
    assert len(raw) < sum(map(len, words)) * 12
    assert Lexicon(build([], [])).get(b"a") is None
    with pytest.raises(ValueError):
        build([b"b", b"a"], [[1], [2]])


def test_suffixes_are_shared():
    stems, ends = [b"a%d" % i for i in range(50)], [b"tion", b"tions", b"ing"]
    words = sorted(s + e for s in stems for e in ends)
    lexicon = Lexicon(build(words, [[i] for i in range(len(words))]))
    assert len(lexicon.final) < 80
    assert [lexicon.get(w) for w in words] == [[i] for i in range(len(words))]


def test_equals_the_library(spec):
    library = Tokenizer.from_file(PATH)
    vocabulary = bpe.Vocabulary(spec)
    words = ["the", "of", "don", "é", "123", "end", "startoftext"]
    encoder = bpe.Encoder(vocabulary, Lexicon(bpe.compiled(vocabulary, words)), memo=50)
    r = random.Random(2)
    pool = "aA1'sdtreΣσςİıßÉéé\u0301ǅ \u00a0\u2003\u200b\u3000日本\x1c\x1f\x85\n\t½²٣नहि😀👍🏽ﬁÅK!?.-_#'ll'Re\x00\x7fʰªº–—’“…€ŉſ"
    texts = ["", " \n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "don't we'll I'VE", "x" * 3000, "the of the", "日本語" * 50]
    texts += ["".join(r.choice(pool) if r.random() < 0.9 else r.choice(["<|endoftext|>", "'ve", " the ", chr(r.randrange(32, 0x2FFF))]) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    for text in texts:
        ids, tokens = encoder.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert tokens == library.decode(want, skip_special_tokens=False), repr(text)


def test_query(spark, spec, corpus_rows):
    library = Tokenizer.from_file(PATH)
    rows = corpus_rows + [(500, "Straße <|endoftext|> x"), (501, "日本語 text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids").repartition(3)
    out = {r.doc_id: r for r in bpe.apply(df, spec, max_words=40, with_ids=True).collect()}
    assert len(out) == len({i for i, _ in rows})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256, out[i].ids, out[i].decoded) == (len(want), sha(" ".join(map(str, want))), sha(decoded), want, decoded)
    assert bpe.apply(df.limit(0), spec).collect() == []


def test_long_words_are_merged_as_the_library_does(spec):
    import time

    r = random.Random(3)
    library = Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(bpe.Vocabulary(spec), None)
    for text in ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "a" * 5000, "ab" * 2500, "the" * 1500]:
        assert [int(i) for i in encoder.encode(text)[0].split()] == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    text = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert len(encoder.encode(text)[0]) > 1_000_000
    assert time.time() - began < 60
