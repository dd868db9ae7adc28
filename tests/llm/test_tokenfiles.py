"""Operator 12: round trips of the coder and of files, ids of the library."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proselens.llm import rangecoder, tokenfiles
from proselens.llm.common import Scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL = {"file_bytes": 30_000, "block_ids": 256, "lanes": 16}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def direct(library, rows):
    """Ids in ascending order of (doc_id, text), null ids first."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def blocks(seed, n):
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, rng.integers(1, 500), rng.integers(1, 400)) for _ in range(n)]
    return out + [np.full(700, 9), np.tile(np.arange(6), 90), np.array([2 ** 32 - 1, 0, 2 ** 32 - 1]), np.array([5]),
                  rng.zipf(1.3, 600) % 49_000, np.arange(600) * 80]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_survive_and_decode_alone(seed):
    some = blocks(seed, 12)
    coded = [(a, len(b), w) for b, (a, w) in zip(some, rangecoder.encode(some))]
    for got, want in zip(rangecoder.decode(coded), some):
        assert np.array_equal(got, want)
    for one, want in list(zip(coded, some))[::3]:  # whoever shared the arrays
        assert np.array_equal(rangecoder.decode([one])[0], want)
        assert np.array_equal(rangecoder.encode([want])[0][1], one[2])


def test_context_and_frequency_pay_off():
    rng = np.random.default_rng(1)
    skewed = rng.choice(256, 8000, p=(p := 1 / np.arange(1, 257)) / p.sum())
    follows = np.tile(rng.integers(0, 1000, 400), 20)
    bits = [8 * 4 * len(w) / len(b) for b, (_, w) in zip([skewed, follows], rangecoder.encode([skewed, follows]))]
    entropy = -np.sum((q := np.bincount(skewed) / len(skewed))[q > 0] * np.log2(q[q > 0]))
    assert bits[0] < 1.06 * entropy and bits[1] < 2  # against log2(400) of order 0 alone


def test_carries_run_through_words():
    flat = np.array([7, 2 ** 32 - 1, 2 ** 32 - 1, 5], np.uint32)
    rangecoder._carry(flat, np.array([2]))
    assert flat.tolist() == [8, 0, 0, 5]


def test_damage_is_noticed(tmp_path):
    raw = io.BytesIO()
    writer = tokenfiles.FileWriter(raw, 64, 8)
    ids = np.arange(300, dtype=np.uint32) % 50
    writer.add(np.array([4, 9]), np.array([False, False]), np.array([100, 200]), ids)
    assert writer.close() == (2, 300, len(raw.getvalue()))

    def read(data):
        import pyarrow as pa
        with pa.BufferReader(data) as f:
            end, doc_ids, null, counts = tokenfiles.read_directory(f)
            assert doc_ids.tolist() == [4, 9] and counts.tolist() == [100, 200] and not null.any()
            return np.concatenate(list(tokenfiles.read_blocks(f, end)))

    assert np.array_equal(read(raw.getvalue()), ids)
    for at in (60, len(raw.getvalue()) - 50):
        bad = bytearray(raw.getvalue())
        bad[at] ^= 4
        with pytest.raises((ValueError, zlib.error)):
            read(bytes(bad))


ODD = ["It's a   TEST  <|endoftext|>mid<|endoftext|> \x01 x\x01y \x1c z é é Σς İI ﬁ 中文字 123 ½ ²", None, "", " \n\t ",
       "\x01", "\x01 \x01a \x01", "x" * 5000, "\x00 a\x00b", "don't'll 'S 'VE", "🙂🙂 a🙂 ŉ ß ẞ Ǆ ̀ ́a ​ b"]


def test_ids_are_those_of_the_library(spark, library):
    rows = list(enumerate(ODD, 1)) + [(None, "nobody's"), (2 ** 62, "late"), (-5, "early")]
    got = tokenfiles.encode_and_read(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, 2, **SMALL)
    assert by_id(got.collect()) == by_id(direct(library, rows))


def test_many_files_and_whole_ids(spark, library):
    from conftest import SF001

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    index = tokenfiles.write_token_files(docs, VOCABULARY, 2, Scratch(spark, "t"), **SMALL)
    assert index.count() > 5
    got = tokenfiles.read_token_files(index, with_ids=True, lanes=5).collect()
    assert by_id(tuple(r)[:4] for r in got) == by_id(direct(library, rows))
    text = dict(rows)
    assert all(r.ids == library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2] for r in got)


def test_one_id_for_a_third_of_the_rows(spark, library):
    rows = [(i if i % 3 else 50, f"text number {i} " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = tokenfiles.encode_and_read(docs, VOCABULARY, 2, **SMALL).collect()
    alone = {(d, n, c) for d, _, n, c in direct(library, rows)}
    assert len(got) == 300 and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == alone
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0


def test_memory_of_pieces_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(tokenfiles, "MEMO_PIECES", 3)
    enc = tokenfiles.Encoder(VOCABULARY)
    for _ in range(3):
        ids, counts = enc.encode([(t or "").encode() for t in ODD], 2)
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in ODD]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_odd_tables(odd_documents, odd_rows, no_documents, library):
    got = tokenfiles.encode_and_read(odd_documents, VOCABULARY, 2, **SMALL).collect()
    want = direct(library, [r[:2] for r in odd_rows])
    drop = lambda rows: sorted(((r[0], *r[2:]) for r in rows), key=repr)
    assert drop(map(tuple, got)) == drop(want)
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == len(got)
    assert tokenfiles.encode_and_read(no_documents, VOCABULARY, 2).count() == 0


def test_usual_characters_are_split_as_by_the_library(library):
    """Every character that is lower-cased and split here, next to others."""
    usual = [c for c in map(chr, range(1, 0x10000)) if tokenfiles._USUAL.fullmatch(c)]
    assert len(usual) > 30_000 and all(tokenfiles._USUAL.fullmatch(c.lower()) for c in usual) and not set("<\x01\u0130\u03a3") & set(usual)
    pieces = [f"a{c}B{c}{c}9{c}!{c}'s{c}" for c in usual]
    enc = tokenfiles.Encoder(VOCABULARY)
    assert enc.model is not None
    ids, counts = enc.encode([p.encode() for p in pieces], 2)
    want = [x.ids + [2] for x in library.encode_batch_fast(pieces, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_word_is_merged_once_whatever_stands_around_it(library):
    enc = tokenfiles.Encoder(VOCABULARY)
    texts = [b"wordy Wordy, (wordy) WORDY! wordy's", b"'wordy' wordy; -wordy- \xc2\xabwordy\xc2\xbb"]
    ids, _ = enc.encode(texts, 2)
    assert ids.tolist() == [i for t in texts for i in library.encode(t.decode(), add_special_tokens=False).ids + [2]]
    assert sum(w == "wordy" for w in enc.words.known) == 1 and len(enc.words.known) < 16


def test_a_step_costs_the_same_for_large_alphabets():
    """No table of running sums: what all lanes hold does not grow with the alphabet times the step."""
    rng = np.random.default_rng(5)
    wide = [rng.permutation(6000) for _ in range(3)]
    model = rangecoder._Model(np.stack([np.bincount(np.zeros(6000, int), minlength=rangecoder.LEVELS)] * 3))
    assert not hasattr(model, "inner") and not hasattr(model, "outer") and model.room == 6000
    coded = [(a, len(b), w) for b, (a, w) in zip(wide, rangecoder.encode(wide))]
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode(coded), wide))
