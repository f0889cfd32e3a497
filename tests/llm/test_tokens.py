"""Token-ID files: round trips of blocks and files, and ids against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcemill.llm import queries, tokens

ids_lists = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=900)


@given(ids_lists, st.integers(0, 900), st.integers(0, 900))
@settings(max_examples=150, deadline=None)
def test_blocks_round_trip(ids, a, b):
    packed = tokens.pack(np.array(ids, np.uint32))
    assert tokens.unpack(packed).tolist() == ids
    a, b = min(a, b, len(ids)), min(max(a, b), len(ids))
    assert tokens.unpack(packed, a, b).tolist() == ids[a:b]


def test_outliers_are_exceptions():
    ids = np.full(256, 1000, np.uint32)
    ids[[3, 200]] = 4_000_000_000, 70_000
    ids[7] = 1003
    packed = tokens.pack(ids)
    assert len(packed) < 16 + 11 + 256 * 2 // 8 + 3 * 5 + 1
    assert tokens.unpack(packed).tolist() == ids.tolist()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_vocabulary())


def test_pieces_give_the_ids_of_whole_texts(whole):
    rng = random.Random(5)
    parts = ["a", "Zu", "é", "ß", "中", "日本", " ", "　", " ", "\u0085", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "12", ".", "!?", "<|endoftext|>", "🙂", "\x00", "\x1c", "x" * 60, " ", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    coder = tokens.Encoder(tokens.public_vocabulary())
    for _ in range(2):
        flat, at = coder.ids(np.frombuffer(b"".join(data), np.uint8), offsets)
        for k, text in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def read(spark, rows, folder, schema="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    written = tokens.write_tokens(df, folder, tokens.public_vocabulary(), **options).collect()
    return written, tokens.read_tokens(spark, folder).orderBy("start").collect()


def test_files_hold_documents_in_order(spark, tmp_path, whole):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["one", "Zwei", "trois,", "4", "\n"]) for _ in range(rng.randrange(400)))) for k in range(-5, 60)]
    rows += [(61, None), (62, ""), (63, "long " * 300_000), (None, "b"), (None, "a"), (None, "a"), (7, "again")]
    written, found = read(spark, rows, str(tmp_path / "t"), file_ids=2000)
    assert len(written) > 5 and sum(w.documents for w in written) == len(rows)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows if d is not None)) + [None] * 3
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(whole.encode(t or "", add_special_tokens=False).ids + [0])
    start = 0
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        start += len(ids)
    assert not any(want.values())
    file = tokens.TokenFile(max(written, key=lambda w: w.ids).path)
    assert file.window(250_000, 300_100).tolist() == file.window(0, file.ids)[250_000:300_100].tolist()


def test_empty_table_extra_columns_and_damage(spark, tmp_path):
    assert read(spark, [], str(tmp_path / "none")) == ([], [])
    rows = [(1, "a b", "x", 1, "y"), (2, "c", "x", 2, "y")]
    written, found = read(spark, rows, str(tmp_path / "some"), "doc_id long, text string, tie string, row int, `a.b` string")
    assert [r.doc_id for r in found] == [1, 2]
    with open(written[0].path.removeprefix("file:"), "r+b") as f:
        f.truncate(20)
    with pytest.raises(Exception, match="no whole file"):
        tokens.read_tokens(spark, str(tmp_path / "some")).collect()


def test_query_on_the_whole_table(spark, whole):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    start, want = 0, []
    for d in sorted(texts):
        ids = whole.encode(texts[d], add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = queries.op11_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.col("ids_crc32").cast("long"))
    assert sorted(map(tuple, found.collect())) == want
