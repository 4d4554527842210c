import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lectern.llm import byte_bpe, token_files
from lectern.llm.token_files import EliasFano

JSON = public_tokenizers.path(token_files.VOCABULARY)
RANKS = public_tokenizers.path(byte_bpe.VOCABULARY)
TRICKY = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "it's I'LL don't", "x=1;\t\ty", "naïve café ÀÖß", "你好 世界", "\U0001f600\U0001f600 ok", "<|endoftext|>", "\x00\x01", "a\u00a0b\u2003c\u3000d",
    "\U0010ffff mark", "  lead", "trail  \n ", "123456 7,8.9", "word.word, word! (word)", "e\u0301", "\ufffd", "z" * 500, "ab " * 3000, "\r\nx\r\n", "\u2028line\u2029", "...!!??", "ſt ﬁ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    letters = list("abcdeé ïß .,!?'0123\n\t ​漢字😀\u00a0#*")
    return TRICKY + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_matches_the_plain_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = encoding()
    for r in byte_bpe.round_trip(docs, RANKS, with_ids=True).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, texts[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.decode_batches(byte_bpe.encode_batches(docs, RANKS), RANKS).collect():
        assert r.decoded_text == texts[r.doc_id]


def plain_ranges(text: str, ids: list[int], plain) -> list[tuple[int, int]]:
    """One id after the other: the characters that hold its bytes."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in ids:
        n = len(plain.decode_single_token_bytes(i))
        out.append((owner[at], owner[at + n - 1] + 1))
        at += n
    return out


def test_offsets_match_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain, want = encoding(), {}
    for k, t in enumerate(texts):
        ids = plain.encode_ordinary(t)
        want[k] = plain_ranges(t, ids, plain)
    got = {r.doc_id: list(zip(r.starts, r.ends)) for r in byte_bpe.encode_batches(docs, RANKS).collect()}
    assert got == want
    for r in byte_bpe.round_trip(docs, RANKS).collect():
        assert r.offsets_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
        inside, at, text = 0, 0, texts[r.doc_id].encode()
        for i in plain.encode_ordinary(texts[r.doc_id]):
            inside += text[at] & 0xC0 == 0x80
            at += len(plain.decode_single_token_bytes(i))
        assert r.n_split == inside


def test_bpe_odd_rows(odd, none):
    got = byte_bpe.round_trip(odd, RANKS).collect()
    assert len(got) == 10 and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert {r.decoded_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert byte_bpe.round_trip(none, RANKS).count() == 0


@pytest.mark.parametrize("values", [[0], [5], [0, 0, 0], [0] * 2000 + [10**7], list(range(3000)), [k * k for k in range(3000)], [0] + [10**12] * 1500])
def test_select_finds_every_offset(values):
    e = EliasFano.from_bytes(EliasFano.of(np.array(values)).to_bytes())
    assert e.slice(0, len(values)).tolist() == values and e.slice(7, 7).tolist() == []
    assert all(e.slice(k, k + 700).tolist() == values[k : k + 700] for k in range(0, len(values), 501))
    assert [e.get(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        e.get(len(values))


def test_offsets_take_few_bits():
    v = np.cumsum(np.random.default_rng(2).integers(1, 2000, 100_000))
    assert 8 * len(EliasFano.of(v).to_bytes()) / len(v) < 2.2 + np.log2(1000)


def test_files_hold_the_ids_in_order(spark, texts, tmp_path):
    rng = random.Random(3)
    rows = [(k * 3 - 50, t) for k, t in enumerate(texts)]
    want, at = {}, 0
    plain = Tokenizer.from_file(JSON)
    for doc_id, t in rows:
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        want[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = f"file:{tmp_path}/ids"
    got = token_files.write_and_read(docs, JSON, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    files = sorted(p for p in (tmp_path / "ids").iterdir() if not p.name.startswith("."))
    assert files and [p.suffix for p in files] == [".ids"] * len(files)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(files[0])) as f:
        shard = token_files.Shard(f)
        first = shard.doc_ids(0, 1)[0]
        assert first == -50 and shard.document(0).tolist()[-1] == 2 and len(shard.document(0)) == want[-50][1]


def test_added_tokens_are_units(spark):
    plain = Tokenizer.from_file(JSON)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b\n", "x<|endoftext|>y.", "\n<|endoftext|>\n\n<|endoftext|> ", "<|endoftext|", "ab <|endoftext|><|endoftext|> cd"]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, tie long, text string")
    whole = token_files.Bounds(*(np.zeros(n, np.int64) for n in (0, 1, 1)))
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_files.encoded(docs, JSON, whole).collect()}
    assert got == {k: plain.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
    assert got[0] == [50256, 2]


def test_shards_are_told_by_id_and_tie():
    rng = np.random.default_rng(4)
    rows = sorted(((None if rng.random() < 0.3 else int(rng.integers(-3, 4)), int(rng.integers(-9, 10))) for _ in range(400)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    begins = sorted({0, *rng.integers(1, 400, 20).tolist()})
    firsts = [rows[k] for k in begins if k == 0 or rows[k] != rows[k - 1]]
    known = [f for f in firsts if f[0] is not None]
    bounds = token_files.Bounds(*(np.array(x, np.int64) for x in ([f[1] for f in firsts if f[0] is None], [f[0] for f in known], [f[1] for f in known])))
    got = bounds.shards(pa.array([r[0] for r in rows], pa.int64()), np.array([r[1] for r in rows]))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert got.tolist() == [sum(order(f) <= order(r) for f in firsts) - 1 for r in rows]


def test_one_id_fills_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_BYTES", 200)
    rows = [(7, f"text number {k}") for k in range(200)] + [(None, f"none {k}") for k in range(100)] + [(k, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file:{tmp_path}/ids"
    got = sorted(token_files.write_and_read(docs, JSON, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert len([p for p in (tmp_path / "ids").iterdir() if p.suffix == ".ids"]) > 3


def test_files_odd_rows(odd, none):
    got = token_files.write_and_read(odd, JSON).collect()
    assert len(got) == 10
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert {r.doc_id for r in sorted(got, key=lambda r: r.start)[:2]} == {None}
    assert token_files.write_and_read(none, JSON).count() == 0
