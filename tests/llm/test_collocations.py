import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import collocations, perfecthash

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plainly(rows, least=10, most=3, top=2000):
    """The definition, with dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [b for (v, x), b in f.items() if v == lang and len(x) > len(w) and b >= least and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * b >= 50 * a for b in longer):
            score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for lang, p, a, l, r, m, s in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p, a, l, r, m, s))
    return ranked


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma.", "delta", "été", "x\x00y", "zz", "Beta", "eta,", "漢字"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "...", "one\ttwo  three " * 12, "one two\nthree. one two", "Solo", "red red red red " * 6]
    return [(rng.choice(["en", "fr", None, "und"]), t) for t in texts] + [("en", texts[3]), ("en", texts[3])]


def collected(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


@pytest.mark.parametrize("sizes", [{}, {"filter_bits": 11, "volume_keys": 40, "buffer_keys": 50}])
def test_phrases_match_the_definition(spark, prose, sizes):
    """Also with a crowded filter, several volumes and full buffers."""
    rows = [(*r, i, 2, "x", 7) for i, r in enumerate(prose)]
    frame = spark.createDataFrame(rows, "lang string, text string, doc_id long, a long, phrase string, k1 long").repartition(5)
    want = plainly(prose)
    assert len(want) > 40 and collected(collocations.mine(frame, **sizes)) == sorted(want)


def test_longer_phrases_and_a_short_list(spark, prose):
    frame = spark.createDataFrame(prose, "lang string, text string").repartition(3)
    assert collected(collocations.mine(frame, most_words=4, least=5, top=7)) == sorted(plainly(prose, 5, 4, 7))


def test_matches_sql(spark, docs, tmp_path, nothing):
    docs.union(docs).union(docs).select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({collocations.OP11_SQL})").fetchall())
    assert want and collected(collocations.mine(spark.read.parquet(str(tmp_path / "documents.parquet")))) == want
    assert collocations.mine(nothing).count() == 0


def test_scores_are_exact(spark):
    rows = [(10, 10, 10), (3_000_000_000, 3_000_000_001, 3_000_000_007), (10**15, 10**15 + 1, 10**15 + 3), (10, 7 * 10**12, 10**13), (2, 3, 3)]
    frame = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in frame.collect())


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.Generator(np.random.PCG64(5))
    k1, k2 = rng.integers(0, 1 << 63, (2, 20_000), dtype=np.uint64) * np.uint64(2)
    k1[:50] = k1[0]  # keys of one first half
    shard = k1 >> np.uint64(64 - perfecthash.SHARD_BITS)
    found = perfecthash.PerfectHash([(int(s), *perfecthash.build_shard(k1[shard == s], k2[shard == s])) for s in np.unique(shard)])
    slots = found.slots(k1, k2)
    assert sorted(slots.tolist()) == list(range(20_000))
    assert (found.slots(k1, k2 + np.uint64(1)) == -1).all() and (found.slots(rng.integers(0, 1 << 63, 999, dtype=np.uint64), k2[:999]) == -1).all()
    assert perfecthash.PerfectHash([]).slots(k1, k2).max() == -1
    with pytest.raises(ValueError, match="distinct"):
        perfecthash.build_shard(k1[:1].repeat(2), k2[:1].repeat(2))
