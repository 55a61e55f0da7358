import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabdelta.llm import bpe, bpe_tree, packing, token_counts

ODD = ["", " ", "a", "Don't  stop\n\n 12 ½  x", "naïve café\t\t\r\n", "\x1c\x1d x\x85y\xa0z", "日本語 テスト", "🙂🙂 ok", "x" * 5000, "ab " * 3000, "<|endoftext|> is text", "é ­​", "١٢٣ ǅ", "᠎ ᲀ\U0001e900", None]


def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_fast_ids_equal_the_library():
    enc, ref, rnd = bpe.json_bpe(bpe.default_path()), reference(), random.Random(1)
    letters = "abcde 'stllrev 0123 \n\t.,!?-éüñß\xa0½ªºɏ<>|"
    for text in [x for x in ODD if x is not None] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))) for _ in range(300)]:
        assert enc.encode(text).tolist() == ref.encode(text, add_special_tokens=False).ids, text


def test_ranks_of_the_json_file_equal_the_rank_file():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert bpe.json_bpe(bpe.default_path()).fast._mergeable_ranks == ranks


def check_pieces(rows, docs, tiers=packing.TIERS):
    ref = reference()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = ref.encode(text or "", add_special_tokens=False).ids + [0]
        own, at = sorted(by_doc[doc_id], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert bytes(r.token_bytes) == part and zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padded = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tiers[-1]
        padded += 0 if at & (at - 1) == 0 else tiers[-1] - at
    return padded


def test_packing(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["alpha", "beta", "x1", "né"]) for _ in range(rnd.choice([0, 3, 50, 400, 3000])))) for k in range(80)] + [(100 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(df, block_tokens=5000).withColumn("ids_crc32", F.crc32("token_bytes")).collect()
    assert check_pieces(rows, docs) == 0
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, {})[r.sequence_id] = r.sequence_tokens
    assert max(sum(g.values()) for g in groups.values()) <= 2.5 * packing.STEP_TOKENS


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), tiers=(100, 1000))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=40), st.booleans())
def test_pack_block_keeps_every_token_once(lengths, last):
    done, rest = packing.pack_block([(k, 0, n) for k, n in enumerate(lengths)], (16, 32, 64), last)
    seen = sorted(p for s in done for p in s) + sorted(rest)
    cover = {}
    for d, s, n in seen:
        for x in range(s, s + n):
            assert (d, x) not in cover
            cover[d, x] = 1
    assert len(cover) == sum(lengths)
    sizes = [sum(p[2] for p in s) for s in done]
    assert all(n & (n - 1) == 0 for n in sizes) and (not last or not rest)


def tree(leaf, window):
    return bpe_tree.TreeBpe(bpe_tree.default_path(), leaf=leaf, window=window)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'st0\n\t\x0b\x1c\x85\xa0 é日🙂.,!")), max_size=120), st.sampled_from([(1, 1), (2, 1), (5, 2), (16, 3)]))
def test_tree_encodes_as_the_whole_and_decodes(text, sizes):
    t = tree(*sizes)
    ids = t.encode(text)
    assert ids == t.encoding.encode_ordinary(text)
    assert t.decode(ids) == text.encode()


def test_tree_join_is_associative():
    t, text = tree(4, 1), "one two'll  three\n\nfour 55 "
    n = len(text)
    enc = t.encoding.encode_ordinary
    for a in range(1, n - 1):
        for b in range(a + 1, n):
            left = t.join(text, 0, b, n, t.join(text, 0, a, b, enc(text[:a]), enc(text[a:b])), enc(text[b:]))
            right = t.join(text, 0, a, n, enc(text[:a]), t.join(text, a, b, n, enc(text[a:b]), enc(text[b:])))
            assert left == right == enc(text)


def test_texts_without_blanks_have_sync_points():
    t = tree(64, 4)
    for part, most in (("日本語のテスト。", 40), ("f(x1,y2){return[a-b,'c'];}", 40), ("aB3dE5gH7jK9", 40)):
        text = part * 500
        assert t.encode(text) == t.encoding.encode_ordinary(text)
        a, b = t._stable(text, 0, len(text) // 2, len(text))
        assert b - a <= most


def test_encode_decode_rows(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, decoded string")
    rows = {r.doc_id: r for r in bpe_tree.encode_decode(df, leaf=64, flush_bytes=50).collect()}
    enc = tree(10**9, 1).encoding
    for k, t in enumerate(ODD):
        assert rows[k].token_ids == enc.encode_ordinary(t or "") and rows[k].n_tokens == len(rows[k].token_ids)
        assert hashlib.sha256(bytes(rows[k].decoded)).digest() == hashlib.sha256((t or "").encode()).digest()
    assert bpe_tree.encode_decode(df.limit(0)).count() == 0


def test_length_histogram_and_suffix_sums(spark):
    rnd = random.Random(4)
    texts = [" ".join(["word"] * rnd.randint(0, 60)) for _ in range(120)] + [None]
    lengths = [len(reference().encode(t or "", add_special_tokens=False).ids) for t in texts]
    hist = token_counts.histogram(token_counts.token_lengths(spark.createDataFrame([(t, 1) for t in texts], "text string, n_docs int")))
    for width, levels in ((8, 1), (3, 2)):
        sums = token_counts.suffix_sums(hist, width=width, levels=levels)
        got = {r.n_tokens: r for r in sums.collect()}
        assert set(got) == set(lengths)
        for L, r in got.items():
            ge = [x for x in lengths if x >= L]
            assert (r.docs_ge, r.tokens_ge, r.docs_lt) == (len(ge), sum(ge), len(lengths) - len(ge))
            assert r.truncated_total == sum(min(x, L) for x in lengths) and r.tokens_lost == sum(max(0, x - L) for x in lengths)
            s = sorted(lengths)
            assert s[r.rank_lo - 1] == s[r.rank_hi - 1] == L
    limits, shares = (0, 7, 33, 1000), (0.0, 0.5, 0.9, 1.0)
    for x in token_counts.truncated_totals(sums, limits).collect():
        assert (x.tokens_kept, x.docs_cut) == (sum(min(v, x.limit) for v in lengths), sum(v > x.limit for v in lengths))
    for x in token_counts.quantiles(sums, shares).collect():
        assert x.n_tokens == sorted(lengths)[max(1, -(-int(x.share * 1000) * len(lengths) // 1000)) - 1]
    whole = token_counts.report(sums, limits, shares).collect()
    assert [sum(r.asked == k for r in whole) for k in ("length", "limit", "quantile")] == [len(got), 4, 4]
    empty = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(spark.createDataFrame([], "text string"))))
    assert empty.count() == 0 and token_counts.report(empty).count() == 0


def test_registered_token_counts_equal_brute_force(spark):
    from tabdelta.llm import queries

    sf = "/root/testdata/sf0.001"
    n = sorted(len(reference().encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())
    rows = queries.op6_token_counts(spark, sf).collect()
    by = lambda kind: [r for r in rows if r.asked == kind]
    assert sorted((r.n_tokens, r.n_docs, r.docs_ge, r.tokens_ge) for r in by("length")) == [(x, n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x)) for x in sorted(set(n))]
    assert {r.n_tokens: (r.truncated_total, r.tokens_lost, r.docs_cut) for r in by("limit")} == {x: (sum(min(y, x) for y in n), sum(max(0, y - x) for y in n), sum(y > x for y in n)) for x in token_counts.LIMITS}
    assert {r.share: r.n_tokens for r in by("quantile")} == {q: n[max(1, -(-round(q * 100) * len(n) // 100)) - 1] for q in token_counts.SHARES}
