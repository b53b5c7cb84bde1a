import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from screenlens.llm import bpe


def reference():
    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(3)
    out = ["", "Hello, it's <|endoftext|>THE<|startoftext|> end", "<|endoftext|", "ΣΑΣ ΟΔΟΣ", "ȩ́ ẛ̣ İ", "x\x1cy\x85z\xa0w", "²½¼ 12 ٣"]
    out += ["".join(rng.choice("abth") for _ in range(n)) for n in (49, 50, 51, 52, 200, 3000)] + ["a" * 999, "=" * 5000]
    for top in (0x7F, 0xFF, 0x250, 0x3000, 0xFFFF, 0x1FFFF):
        for _ in range(60):
            out.append("".join(c for c in (chr(rng.randrange(top)) for _ in range(40)) if not 0xD800 <= ord(c) < 0xE000))
    return out


def test_codec_is_the_library():
    t, merges = reference(), bpe.Merges(bpe.tokenizer_path())
    some = [b"the", b"then", b"hen", b"end", b",", b"it"]
    codec = bpe.Codec(bpe.tokenizer_path(), bpe.compile_lexicon({w: merges.word(w) for w in some}))
    for x in texts():
        want = t.encode(x, add_special_tokens=False).ids
        got = codec.encode([x])[0]
        assert np.frombuffer(got, "<u4").tolist() == want, repr(x)
        assert codec.decode(got) == t.decode(want, skip_special_tokens=False), repr(x)


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i] for i, w in enumerate(["tap", "taps", "top", "tops", "a", "ab"])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    found = lex.places([*words, b"ta", b"tapsx", b"zz"])
    assert [int(lex.word_ids(p)[0]) for p in found[:-3]] == list(range(6)) and (found[-3:] == -1).all()
    assert len(lex.final) == 6  # root, t, (ap|op) once, p's end with s, s's end, a
    assert (bpe.Lexicon(bpe.compile_lexicon({})).places([b"x"]) == -1).all()


def test_query(spark, docs):
    t = reference()
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.digest(bpe.code(spark, docs, words=5)).collect()}
    want = set()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == want
    assert bpe.code(spark, docs.limit(0)).count() == 0
