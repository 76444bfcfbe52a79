import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from inkfold.llm.bpe import LONGEST_KEPT, Memory, WordBpe, decode_ids, default_tokenizer, encode_texts

HARD = [None, "", " \t\n", "don't WE'LL", "a" * 20000, "ab" * 300, "haha" * 50, "<|endoftext|>x<|startoftext|><|endoftext|", "ΑΣ ΣΑΣ İ ß ﬁ", "e\u0301 \u200b 🙂日本", "</w> w>", "\x1c\x85\xa0x"]


def library():
    return Tokenizer.from_file(default_tokenizer())


def test_random_texts_equal_library():
    r, tok, mine = random.Random(5), library(), WordBpe(open(default_tokenizer(), encoding="utf-8").read())
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzaeaeae'  .!?ΣßÉ日本語🙂0123\u0301<|/w>") for _ in range(r.randint(0, 80))) for _ in range(2000)]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == want.ids
        assert mine.decode(want.ids) == tok.decode(want.ids, skip_special_tokens=False)


def test_stretches_equal_library():
    """Words with marks, apostrophes, all kinds of white space, and separators that only Python takes for it."""
    r, tok, mine = random.Random(6), library(), WordBpe(open(default_tokenizer(), encoding="utf-8").read())
    between = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", ""]
    words = ["the", "don't", "I'LL", "'s", "''s", "Straße", "ÿ÷×ª", "été", "x1", "12", "a.b", "...", "?!", "ñandú", "ΑΣ", "ǆ", "日本", "\x00", "İ", "½"]
    texts = ["".join(r.choice(words) + r.choice(["", "", ".", ",", "!", "?;"]) + r.choice(between) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == want.ids and mine.encode(text) == want.ids


def test_known_stretches_are_not_cut_again():
    """The second time a text is neither cut by the pattern nor encoded: it only costs one look-up a stretch."""
    mine, text = WordBpe(open(default_tokenizer(), encoding="utf-8").read()), "Don't stop, größer: (a+b)!\n\tagain, don't stop. x2"
    once = mine.encode(text)
    mine.pieces = mine.automaton = None
    assert mine.encode(text) == once == library().encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    built = []
    memory = Memory(lambda key: built.append(key) or key.encode(), room=3)
    for key in "abcadbeafaaga":
        assert memory[key] == key.encode() and len(memory) <= 3 and len(memory.older) <= 3
    assert built.count("a") == 1 and set(built) == set("abcdefg")
    long = "x" * (LONGEST_KEPT + 1)
    assert memory[long] == long.encode() and long not in memory


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "'x' AS n_tokens")
    out = encode_texts(df, default_tokenizer())
    tok, want = library(), []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False).encode()
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r)[:4] for r in out.collect()), key=key) == sorted(want, key=key)
    back = {r.doc_id: r.decoded for r in decode_ids(out, default_tokenizer()).collect()}
    assert all(back[i] == tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows)


def test_hard_texts(spark):
    check(spark, list(enumerate(HARD)) + [(None, "x y"), (3, "don't WE'LL")])
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), default_tokenizer()).count() == 0


def test_whole_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
