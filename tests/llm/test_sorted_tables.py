import io
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from findlight.llm import sorted_tables as st
from findlight.llm.fast_encode import Encoder, encoder


def brute(texts):
    """texts: (id, text) in order; what must be read back."""
    own, out, start = Tokenizer.from_file(st.tokenizer_path()), {}, 0
    for i, t in texts:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_encoding_equals_the_library():
    own, made = Tokenizer.from_file(st.tokenizer_path()), Encoder(st.tokenizer_path(), keep=50)
    rng = random.Random(3)
    letters = "aZé'sS ßÀĳŉ1²½9 .,!'\t\n\"#<|>end\xa0\x85\x1cİ́Σ中\U0001f600ǅ\xadstve"
    texts = ["", " ", "It's we've I'LL don't", "a<|endoftext|>b", "<|startoftext|>", "Ünï ﬁ Å Å", "x" * 5000, "İstanbul ΑΣ ΑΣ."]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(made.encode(t), "<u2").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_table_reads_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = st.op9_sorted_tables(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_many_shards_edges_and_lookup(spark, tmp_path):
    long = "word " * 40_000
    rows = [(i * 7 - 50, f"text number {i} " * (i % 9)) for i in range(200)] + [(None, "none"), (3000, None), (3001, ""), (3002, long)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    path = str(tmp_path / "out")
    st.write(docs, path, st.tokenizer_path(), shard_bytes=4000)
    want = brute(sorted(rows, key=lambda r: st.key_of(r[0])))
    got = st.read_back(spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    files = [f for f in sorted((tmp_path / "out").glob("part-*")) if f.stat().st_size]
    assert len(files) > 5
    shards = [st.Shard(f.open("rb")) for f in files]
    made = encoder(st.tokenizer_path())
    for i, t in rows[::11] + rows[-4:]:
        assert [v for s in shards for v in s.lookup(i)] == [made.encode(t) + b"\2\0"]
    assert not any(s.lookup(999_999) for s in shards)
    assert sum(s.may_have(i) for s in shards for i in range(10**6, 10**6 + 200)) < 0.05 * 200 * len(shards)


def test_repeated_ids_span_blocks_and_empty_tables():
    entries = [(st.key_of(5), bytes([i % 251, 0])) for i in range(500)] + [(st.key_of(6), b"\1\0")]
    data = b"".join(p + b"\n" for p in st.parts_of_shard(entries, 2, 0, block_bytes=100))
    shard = st.Shard(io.BytesIO(data))
    assert shard.lookup(5) == [v for _, v in entries[:-1]] and shard.lookup(6) == [b"\1\0"] and len(shard.blocks) > 10
    assert list(st.parts_of_shard([], 2, 0)) == []


def test_empty_table(spark):
    assert st.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
