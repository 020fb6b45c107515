"""Packing and token counts against plain encoding."""

import zlib
from collections import defaultdict

import numpy as np

from inkwell.llm.packing import pack_documents
from inkwell.llm.token_counts import length_histogram, token_lengths
from inkwell.llm.tokens import TokenBytes, default_path

ODD = [
    None, "", " ", "a", "one  two   three", "tabs\tand\nlines \n here ", "don't 's it's", "日本語 のテキスト 123 45",
    "x <|endoftext|> y", "nb sp   wide", "word " * 3000, "\n\n\n", " lead", "trail ", "é" * 700,
    "mixed 1a2b ,.;! ?? <b>", "a\u0085b c\u0085 d",
]


def _plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_fast_ids_are_those_of_the_file():
    encode, plain = TokenBytes(default_path()), _plain()
    assert encode.fast
    rng = np.random.default_rng(5)
    signs = list(" \n\t\u0085\u00a0\u3000\x1c\x0b'stdml1٣aéßжけ。!<|>_")
    odd = ["".join(rng.choice(signs, 30)) for _ in range(800)]
    for x in [*ODD, "a" * 9000, *odd]:
        if x is not None:
            assert np.frombuffer(encode(x), dtype="<u4").tolist() == plain(x), x


def test_every_id_lies_in_one_piece(spark):
    plain, texts = _plain(), ODD * 12
    df = spark.createDataFrame([(i if i % 9 else None, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, offset int")
    rows = pack_documents(df.filter("doc_id is not null").repartition(3), group_tokens=5000).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, x in enumerate(texts):
        if i % 9 == 0:
            continue
        ids, at = [*plain(x or ""), 0], 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and {r.sequence_length for r in s} == {at}
    assert pack_documents(df.filter("false")).count() == 0
    assert pack_documents(df.filter("doc_id is null")).filter("doc_id is null").count() > 0


def test_histogram_answers_every_limit(spark):
    plain = _plain()
    lengths = [len(plain(x or "")) for x in ODD * 2]
    df = spark.createDataFrame([(i, x, "n") for i, x in enumerate(ODD * 2)], "doc_id long, text string, n_tokens string")
    got = {r.n_tokens: r for r in length_histogram(token_lengths(df), limits=(4, 100_000)).collect()}
    assert set(got) == set(lengths) | {4, 100_000}
    for n, r in got.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    none = length_histogram(token_lengths(df.filter("false")), limits=(8,)).collect()
    assert [(r.n_tokens, r.total_docs, r.quantile) for r in none] == [(8, 0, None)]
