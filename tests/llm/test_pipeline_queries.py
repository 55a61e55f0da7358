import base64
import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tabdelta.llm import pii, queries

from .test_dedup import linked
from .test_packing_bpe import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    plain = lambda rows: sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_registered_packing_and_encoding_equal_the_libraries(spark):
    """op1 and op2 over every document of a table, by the libraries' own ids."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
    ref = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op2_bpe_tree(spark, SF).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        ids = ref.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in queries.op1_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids, at = whole.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {d for d, kept in con.sql(queries.OP3).project("doc_id, kept").fetchall() if kept}  # the verdict by SQL, not by the stage
    by_text = {}
    for d in docs:
        if d.doc_id in good:
            by_text.setdefault(d.text or "", []).append(d.doc_id)
    texts = {max(ids): t for t, ids in by_text.items()}
    components = linked(sorted(texts.items()))
    stay = sorted(d for d in texts if components[d][1] == d)
    want = [(d, pii.pseudonymise_text(texts[d], pii.DEMO_KEY)[0]) for d in stay]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(stay)
    assert check_pieces(rows, want) == 0


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    text = " ".join(f"word{k}" for k in range(70)) + " the.72@mail3.example.com"
    odd = [(1, text, None, None, None, True), (1, text, None, None, None, True), (None, text + " x", "en", "s", 3, None), (2, None, "en", "s", 0, False), (3, "", None, "s", 0, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.select("doc_id").distinct().count() == (1 if rows else 0)
