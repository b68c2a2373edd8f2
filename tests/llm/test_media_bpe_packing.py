import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesselark.llm import bpe, media, packing

TEXTS = [None, "", "a", "plain words, and more.", "é" * 500, "\x00\x01\x80ÿ" * 40, "日本語 テキスト 😀", "a" * 63, "a" * 64, "a" * 65, "tab\tand\n\nlines  \r\n x", "word " * 30000, "don't 's 've 12,345.67 x²", " leading", "trailing  "]


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "c"), (1, "", "again"), (1, "", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_jpeg_gives_back_any_bytes():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 2, 7, 65)]
    payloads += [b"\x80" * 64, b"\x80" * 640, bytes([0] * 63 + [128]), b"\xff" * 128, bytes([128] * 20 + [1] + [128] * 42 + [9])]
    files = media.encode(payloads)
    back = media.decode(files)
    assert [media.payload_of(*x) for x in back] == payloads
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    with pytest.raises(ValueError):
        media.encode([b"abc"])
    with pytest.raises(ValueError):
        media.Parsed(b"no file")


def test_jpeg_scans_are_standard():
    """Decodes one scan by the plain bit-by-bit procedure."""
    payload = bytes([128, 7, 128, 128, 200] + [128] * 40 + [3] + [128] * 18)
    parsed = media.Parsed(media.encode([payload])[0])
    bits = "".join(f"{b:08b}" for b in parsed.scan.split(b"\xff\xd0")[0].replace(b"\xff\x00", b"\xff"))
    tables = {}
    for key, (counts, symbols) in parsed.huffman.items():
        codes, lengths = media.canonical(list(counts), symbols)
        tables[key >> 4] = {f"{int(codes[s]):0{int(lengths[s])}b}": s for s in symbols}
    at, out = 0, []

    def symbol(table):
        nonlocal at
        for n in range(1, 17):
            if bits[at : at + n] in tables[table]:
                s = tables[table][bits[at : at + n]]
                at += n
                return s
        raise AssertionError

    def value(size):
        nonlocal at
        raw = bits[at : at + size]
        at += size
        return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

    out.append(value(symbol(0)))
    while len(out) < 64:
        s = symbol(1)
        if s == 0:
            out += [0] * (64 - len(out))
        else:
            out += [0] * (s >> 4)
            out.append(value(s & 15))
    assert bytes(v + 128 for v in out) == payload


def test_media_columns(spark):
    got = media.digests(media.media_columns(frame(spark))).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        if r.doc_id is None:
            continue
        raw = (TEXTS[r.doc_id] or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bpe_matches_the_rank_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(open(path, "rb").read()))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = bpe.byte_bpe(frame(spark), path, public_tokenizers.PATTERN)
    for r in bpe.digests(tokens).collect():
        if r.doc_id is None:
            continue
        text = TEXTS[r.doc_id] or ""
        ids = want.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_documents(spark, sf_dir):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(open(path, "rb").read()))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.byte_bpe(docs, path, public_tokenizers.PATTERN).collect():
        assert r.ids == want.encode_ordinary(texts[r.doc_id])


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    w, want = packing.WordIds(open(path).read()), Tokenizer.from_file(path)
    assert np.frombuffer(w.encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]
    odd = ["İstanbul, Ä̈ é don't! it's word's", "'’s a.b.c 12,5 ΣΑΣ.", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext", "a<|endoftext|>b\x1fc", "\x1c a\x1db   c d", "İ", "...", "á. éx", "x" * 300]
    for t in odd + [t or "" for t in TEXTS]:
        assert np.frombuffer(w.encode(t), "<u4").tolist() == want.encode(t, add_special_tokens=False).ids


def test_memory_of_words_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 10_000)
    w = packing.WordIds(open(public_tokenizers.path("word_bpe_49k.json")).read())
    for i in range(40):
        w.encode("x" * 3000 + str(i))
    assert sum(len(k) + len(v) for k, v in w.known.items()) < 40_000


def test_new_words_of_many_texts_go_to_the_tokenizer_together(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    w, want, calls = packing.WordIds(open(path).read()), Tokenizer.from_file(path), []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(want, name)

    w.tokenizer = Counted()
    monkeypatch.setattr(packing, "LINE_WORDS", 1000)
    monkeypatch.setattr(packing, "TEXTS_DEALT", 7)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcéßЖ1.,!\u00a0\u2028\x1c", weights=[9] * 6 + [1] * 7, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["", "  a  b ", "a<|endoftext|>b c", "\t\n"]
    got = w.encode_all(pa.array([None] + [t.encode() for t in texts], pa.large_binary()).slice(1))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 20  # not a few for each of the texts


def test_equal_rows_are_dealt_over_tasks(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 1, 7)] * 4000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, ["doc_id"], size=100, task_tokens=1000).collect()
    per = {}
    for r in got:
        per[r.sequence_id >> 40] = per.get(r.sequence_id >> 40, 0) + 1
    assert len(got) == 4000 and len(per) == 4 and max(per.values()) < 1200
    check_packing(got, 100)


def check_packing(pieces, size):
    by_doc, by_bin = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return by_doc, by_bin


def test_packing_places_every_token_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate([*TEXTS, "end <|endoftext|> <|startoftext|>of"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack_documents(docs, path).collect()
    by_doc, by_bin = check_packing(pieces, 2048)
    w = packing.WordIds(open(path).read())
    total = 0
    for i, t in rows:
        ids = w.encode(t or "") + bytes(4)
        total += len(ids) // 4
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) // 4
        assert all(r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    assert len(by_bin) == -(-total // 2048)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_repeated_rows_and_null_ids_are_packed_one_by_one(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(None, "a b", "x"), (2**60 + 1, "c", "y"), (2**60 + 1, "c", "y"), (None, None, None)], "doc_id long, text string, piece string")
    got = packing.pack_documents(docs, path).collect()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == [str(2**60 + 1)] * 2 + ["None"] * 2
    check_packing(got, 2048)


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 2)
    # 6, 7 are open; 8 needs a third, so 7 (the fuller) closes; 3 fits only beside 6; 4 needs another
    assert [bins.put(n)[0] for n in (6, 7, 8, 3, 4)] == [0, 1, 2, 0, 3]
    bins = packing.OpenBins(10, 1)
    assert [bins.put(n)[0] for n in (6, 9, 4, 1)] == [0, 1, 2, 2]


def test_bins_never_overflow_on_random_items():
    rng = np.random.default_rng(4)
    for most in (1, 3, 50):
        bins, load = packing.OpenBins(64, most), {}
        for n in rng.integers(1, 65, 2000).tolist():
            b, offset = bins.put(n)
            assert load.get(b, 0) == offset
            load[b] = offset + n
            assert load[b] <= 64 and bins.open <= most


def test_many_long_pieces_leave_their_space_to_short_ones(spark):
    """More half-full sequences than 4,096 come before the first short piece."""
    long, short = 6000, 12000
    pieces = spark.range(long + short).select(F.col("id"), F.when(F.col("id") < long, 1200).otherwise(400).cast("long").alias("length"))
    got = packing.pack(pieces, ["id"]).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == long and all(r.n == 2000 for r in got)


def test_ids_of_letters_whose_lower_case_ends_in_a_mark():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    file = Tokenizer.from_file(path)
    rng = random.Random(12)
    texts = [f"{core}{m} geldi {core}{m}{m}" for m in packing.MARKS for core in ("KEDİ", "İ", "SAHİBİ", "ΟΔΟΣ")]
    letters, marks = "abcDEFİIıßΣςéÉn" + "̧́̇ि‍", packing.MARKS + "’…`~\\^1٣̸̇"
    for _ in range(4000):
        texts.append(" ".join("".join(rng.choices(letters, k=rng.randint(0, 5))) + "".join(rng.choices(marks, k=rng.choice((0, 0, 1, 2)))) for _ in range(rng.randint(1, 5))))
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == file.encode(t, add_special_tokens=False).ids, t


def test_columns_that_clash_with_a_packing_s_own(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9), (2, None, 7, 8, 9)], "doc_id long, text string, sequence_id long, offset long, __place long")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.length, r.offset) for r in rows) == [(1, 4, 0), (2, 1, 4)]
    pieces = spark.createDataFrame([(3, 7)], "length long, sequence_id long")
    with pytest.raises(ValueError, match="sequence_id"):
        packing.pack(pieces, [])
