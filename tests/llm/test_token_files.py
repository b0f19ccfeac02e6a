import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs

from orbweave.llm import alignment, tokenfiles
from orbweave.llm.packing import tokenizer_file

WORDS = tokenizer_file()
BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoded(corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return sorted(((r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus), key=lambda x: (x[0] is not None, x[0] or 0))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_give_back_every_document(spark, docs, encoded, tmp_path):
    folder = str(tmp_path / "ids")
    files = tokenfiles.write_tokens(docs, folder, WORDS, file_bytes=20_000).collect()
    assert len(files) > 1 and sum(f["n_docs"] for f in files) == len(encoded)
    want, before = [], 0
    for name, ids in encoded:
        want.append((name, before, len(ids), crc(ids), ids))
        before += len(ids)
    found = sorted(tuple(r) for r in tokenfiles.read_tokens(spark, folder, with_ids=True).collect())
    # Rows that repeat are equal, so each keeps a place of its own.
    assert found == sorted(want)


def test_one_document_is_read_by_itself(spark, docs, encoded, tmp_path, monkeypatch):
    folder = str(tmp_path / "ids")
    tokenfiles.write_tokens(docs, folder, WORDS)
    wanted = {20, 14, 7, 10**12}
    found = sorted((r["id"], r["ids"]) for r in tokenfiles.read_tokens(spark, folder, ids=wanted, with_ids=True).collect())
    assert found == sorted((n, ids) for n, ids in encoded if n in wanted) and len(found) == 5
    name = next(f["file"] for f in tokenfiles.manifest(spark, folder).collect())
    file = tokenfiles.TokenFile(folder, name, {})
    assert [len(file.document(k)) for k in range(len(file.ids))] == file.n_ids.tolist()


def test_another_dictionary_and_a_torn_file_are_errors(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    tokenfiles.write_tokens(docs, folder, WORDS)
    name = next(f["file"] for f in tokenfiles.manifest(spark, folder).collect())
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles.TokenFile(folder, name, {folder: b"other"})
    files, place = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{place}/{name}") as f:
        raw = f.read()
    with files.open_output_stream(f"{place}/torn.bin") as f:
        f.write(raw[:-3])
    with pytest.raises(ValueError, match="whole"):
        tokenfiles.TokenFile(folder, "torn.bin", {})


def test_dictionary_helps_short_documents(spark, tmp_path):
    rows = [(i, f"the order of the day number {i * 37 % 101} is to read {i * 11 % 53} pages of the book") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    dictionary = tokenfiles.train_dictionary(frame, WORDS)
    ids = np.arange(600, 640, dtype="<u2").tobytes()
    assert dictionary and tokenfiles._decompressor(dictionary).decompress(tokenfiles._compressor(dictionary).compress(ids)) == ids
    size = lambda d: sum(r["bytes"] for r in d.collect())
    own = size(tokenfiles.write_tokens(frame, str(tmp_path / "own"), WORDS))
    plain = sum(len(tokenfiles._compressor(b"").compress(np.array(r["ids"], dtype="<u2").tobytes())) for r in tokenfiles.read_tokens(spark, str(tmp_path / "own"), with_ids=True).collect())
    assert own < 0.8 * plain
    assert tokenfiles.train_dictionary(frame.limit(3), WORDS) == b""


def test_token_files_of_odd_tables(spark, nothing, tmp_path):
    assert tokenfiles.write_tokens(nothing, str(tmp_path / "none"), WORDS).count() == 0
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).count() == 0
    rows = [(None, "a b"), (None, None), (3, "x"), (None, "a b"), (-5, ""), (2**60, "y " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfiles.write_tokens(frame, str(tmp_path / "odd"), WORDS)
    found = sorted(tokenfiles.read_tokens(spark, str(tmp_path / "odd")).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in found] == [None, None, None, -5, 3, 2**60]
    assert [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    assert [r["id"] for r in tokenfiles.read_tokens(spark, str(tmp_path / "odd"), ids=[-5, 4]).collect()] == [-5]


def plainly(texts):
    """Groups, links and digests by sets of ends, on whole texts."""
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    sign = {v: k for k, v in alignment.byte_level_alphabet().items()}
    byte = {c: k for k, c in sign.items()}
    out = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        held_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        held_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(held_a) != (" " + t).encode() or b"".join(held_b) != (" " + t).encode():
            out.append((0, 0, 0, Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in held_a]), np.cumsum([len(x) for x in held_b])
        links, shown, s = Counter(), [], 0
        for e in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            own_a, own_b = [i for i, x in zip(ids_a, ends_a) if s < x <= e], [i for i, x in zip(ids_b, ends_b) if s < x <= e]
            links.update((x, y) for x in own_a for y in own_b)
            shown.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            s = e
        out.append((len(ids_a), len(ids_b), len(shown), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
    return out


ODD = [" ", "  a", "a ", "a  b\n c", "\n x", "x  y", "　z 漢 字한 😀 é x", "▁ mark", "<|endoftext|> <s> <0x41> </s>", "\x00 nul \x7f z", "Don't  we'll\r\n\tgo", "ends odd \t", "été à ß ñ ÷ x"]


@pytest.mark.parametrize("hot", [5, 1 << 17])
def test_alignment_matches_whole_texts(spark, docs, corpus, hot):
    rows = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (None, None)] + [r[:2] for r in corpus if len(r[1] or "") < 20_000]
    rows += rows[3:5]
    frame = spark.createDataFrame([(*r, 9, 1, "x") for r in rows], "doc_id long, text string, row long, pair long, pairs string").repartition(3)
    found, pairs = alignment.align(frame, BYTES, PIECES, hot_pairs=hot)
    plain = plainly([t for _, t in rows])
    held = Counter()
    for *_, links, _ in plain:
        held.update(links.keys())
    top_a, top_b = Counter(), Counter()
    for (a, b), n in held.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    want = [
        (name, n_a, n_b, n_g, sum(links.values()), sum(k for (a, b), k in links.items() if held[a, b] == top_a[a]), sum(k for (a, b), k in links.items() if held[a, b] == top_b[b]), sum(k * held[p] for p, k in links.items()), sha)
        for (name, _), (n_a, n_b, n_g, links, sha) in zip(rows, plain, strict=True)
    ]
    got = [tuple(r[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256")) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == dict(held)


def test_chunks_forgotten_and_long_groups(monkeypatch):
    texts = [f"word{i} other{i % 7},  twice\n end" for i in range(300)] + ["x" * 700, "▁"]
    want = plainly(texts)
    monkeypatch.setattr(alignment, "CACHED_CHUNKS", 50)
    monkeypatch.setattr(alignment, "LONG_GROUP", 1)
    aligner = alignment.Aligner(BYTES, PIECES)
    for at in range(0, len(texts), 20):
        got = aligner.documents([t.encode() for t in texts[at : at + 20]])
        for k, w in enumerate(want[at : at + 20]):
            links = {divmod(p, 1 << 32): n for p, n in zip(got["pairs"][k].tolist(), got["times"][k].tolist(), strict=True)}
            assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], links, got["groups_sha256"][k]) == (w[0], w[1], w[2], dict(w[3]), w[4])


def test_alignment_of_nothing(nothing):
    found, pairs = alignment.align(nothing, BYTES, PIECES)
    assert found.count() == 0 and pairs.count() == 0
