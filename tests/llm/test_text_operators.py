import json
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from orbweave.llm import language, licenses, mixture, packing, quality, tokencount, warc, wordtokens


def against_sql(frame, sql, tmp_path, columns):
    """Rows of the query and of DuckDB over the same documents."""
    frame[0].select("doc_id", "text", "lang", "source").dropDuplicates().write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return sorted(map(repr, want))


def rows_of(frame, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())


def test_quality_matches_sql(spark, docs, tmp_path):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = quality.judge(docs.dropDuplicates(["doc_id", "text"])).withColumnRenamed("id", "doc_id")
    assert rows_of(found, columns) == against_sql([docs], quality.OP4_SQL, tmp_path, columns)


def test_order_of_rules_does_not_change_verdicts(docs, nothing):
    kept = lambda order: sorted((r["id"], r["kept"]) for r in quality.judge(docs, order=order).collect())
    assert kept(list(quality.RULES)) == kept(list(reversed(quality.RULES)))
    assert quality.judge(nothing).count() == 0
    assert len(quality.plan_cascade(quality.with_base(docs), quality.RULES)) == len(quality.RULES)


def test_licenses_match_sql(docs, tmp_path, nothing):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = licenses.scan(docs.dropDuplicates(["doc_id", "text"])).withColumnRenamed("id", "doc_id")
    assert rows_of(found, columns) == against_sql([docs], licenses._sql(), tmp_path, columns)
    assert licenses.scan(nothing).count() == 0


def test_license_places_and_templates(spark):
    rows = [
        (1, "x ALL  rights, reserved cc-by y General Public\nLicense"), (2, "all rights reservedly acc by"), (3, "été cc by"),
        (4, "Some code. Licensed under the Apache License, Version 2.0 (the License)"), (5, "apache version license"), (6, None),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ]
    found = {r["id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (3, 1, 7, "cc-by,gpl,reserved")
    assert found[2]["n_base"] == 0 and found[3]["first_word"] == 1
    assert found[4]["labels"] == "apache-2.0" and found[5]["labels"] == "" and found[7]["labels"] == "mit"
    assert (found[6]["n_words"], found[6]["score"]) == (0, 0.0)


def test_templates_alone_in_pairs_and_all_together(spark, tmp_path):
    """Every template is found by itself, next to any other, and in a file that holds them all."""
    labels = {label for label, _, _ in licenses.TEMPLATES}
    text = [words.title() for _, words, _ in licenses.TEMPLATES]
    n = len(text)
    rows = [(i, f"Some prose here. {text[i]}, and more") for i in range(n)]
    rows += [(1000 + i * n + j, f"{text[i]}.\n\nThen {text[j]}") for i in range(n) for j in range(n)]
    rows += [(9000, "\n".join(text)), (9001, " x ".join(reversed(text)) + " filler" * 5000), (9002, (text[0] + " ") * 500), (9003, "the of and license software " * 2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: set(r["labels"].split(",")) - {""} for r in licenses.scan(frame).collect()}
    own = [licenses.TEMPLATES[i][0] for i in range(n)]
    assert all(own[i] in found[i] for i in range(n))
    assert all({own[i], own[j]} <= found[1000 + i * n + j] for i in range(n) for j in range(n))
    assert labels <= found[9000] and labels <= found[9001] and found[9002] == {"apache-2.0"} and found[9003] == set()
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    few = frame.where("doc_id < 1100 or doc_id >= 9000").selectExpr("*", "'' AS lang", "'' AS source")
    assert rows_of(licenses.scan(few).withColumnRenamed("id", "doc_id"), columns) == against_sql([few], licenses._sql(), tmp_path, columns)


def test_mixture_matches_sql_and_its_targets(spark, docs, tmp_path, nothing):
    once = docs.dropDuplicates(["doc_id"])
    plan, stream = mixture.mix(once, docs_per_block=4, words_per_shard=5000)
    rows = stream.collect()
    taken: dict = {}
    for r in rows:
        taken[r["id"]] = taken.get(r["id"], 0) + r["words"]
    once.select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixture.OP3_SQL).fetchall()
    assert {r[0]: r[4] for r in want} == taken
    assert all(t <= 3 * size for _, size, _, _, t in want)
    by_source = {r["source"]: r for r in plan.collect()}
    for source, p in by_source.items():
        assert abs(sum(r["words"] for r in rows if r["source"] == source) - p["target"]) <= 0.5
    assert mixture.mix(nothing)[1].count() == 0
    mixed = mixture.mixed_documents(once)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(taken.values())
    whole = {r["doc_id"]: r["text"] for r in once.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed)


def test_shards_draw_their_leaf_quotas(spark, docs):
    """Every shard draws exactly the blocks its leaf holds of each source, and no block copy is drawn twice."""
    once = docs.dropDuplicates(["doc_id"])
    _, stream = mixture.mix(once, docs_per_block=4, words_per_shard=5000)
    drawn = {(r["source"], r["block"], r["copy"], r["shard"]) for r in stream.where("copy is not null").collect()}
    assert len({d[:3] for d in drawn}) == len(drawn)
    sources = sorted({d[0] for d in drawn}, key=lambda s: (s is None, s or ""))
    # A block copy whose documents have no words (or none before the quota's end) shows in no row, so quotas bound what is seen.
    seen = np.array([[sum(d[0] == s and d[3] == k for d in drawn) for s in sources] for k in range(max(d[3] for d in drawn) + 1)])
    leaves = mixture.split_tree(seen.sum(axis=0), len(seen))
    assert (leaves.sum(axis=0) == seen.sum(axis=0)).all() and len(seen) > 1
    spans = mixture.spans_of(spark, np.array([700, 0, 41]), 600).collect()
    for s, n in ((0, 700), (2, 41)):
        own = sorted((r["low"], r["high"], r["shard"]) for r in spans if r["s"] == s)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] and a[2] < b[2] for a, b in zip(own, own[1:]))
    tree = mixture.split_tree(np.array([700, 0, 41]), 600)
    assert all(tree[r["shard"], r["s"]] == r["high"] - r["low"] for r in spans)


def test_repeated_rows_are_mixed_each_by_itself(spark):
    rows = [(1, "a b c", "s")] * 2 + [(2, "d e f g", "s")] + [(3, "x " * 200, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, stream = mixture.mix(frame)
    taken: dict = {}
    for r in stream.collect():
        taken[r["row"], r["id"], r["size"]] = taken.get((r["row"], r["id"], r["size"]), 0) + r["words"]
    assert len(taken) == 4 and all(t <= 3 * size for (_, _, size), t in taken.items())
    assert sum(t for (_, i, _), t in taken.items() if i != 3) == 30
    assert sum(len(r["text"].split()) for r in mixture.mixed_documents(frame).where("source = 's'").collect()) == 30


def test_large_pools_split_exactly():
    held = np.array([3_000_000_000, 5, 900_000_000])
    middle, left = mixture.split_node(0, 1000, held)
    assert middle == 500 and (left >= 0).all() and (left <= held).all() and left.sum() == held.sum() // 2


def test_rows_without_an_id_are_mixed(spark):
    rows = [(None if i % 2 else i, f"n{i} " * (5 + i % 7), "ab"[i % 3 == 0]) for i in range(60)]
    rows += [(7, "one two three", "a"), (7, "four five six seven", "b"), (None, None, None), (None, "x y", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["source"]: r["target"] for r in mixture.mix(frame)[0].collect()}
    words = dict.fromkeys(plan, 0)
    mixed = mixture.mixed_documents(frame).collect()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 0.5 for s, t in plan.items()), (words, plan)
    assert sum(r["doc_id"] is None for r in mixed) >= 10
    assert {(r["source"], r["text"].split()[0]) for r in mixed if r["doc_id"] == 7} <= {("a", "one"), ("b", "four")}


def test_rows_without_an_id_are_packed(spark):
    rows = [(None, "one two"), (0, "three"), (None, None), (5, "four five")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.tokenizer_file(), capacity=8).collect()
    assert sorted((r["id"] for r in found), key=repr) == [0, 5, None, None]


def test_targets_and_tree():
    assert mixture.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixture.targets([100, 1, 1], [1, 2, 3]) == [96.0, 3.0, 3.0]
    assert mixture.targets([0, 5], [1, 2]) == [0.0, 5.0]
    quotas = np.array([17, 0, 5, 1000])
    leaves = mixture.split_tree(quotas, 7)
    assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all()
    assert (leaves == mixture.split_tree(quotas, 7)).all()


def test_packing_is_a_partition_of_the_tokens(docs, corpus, nothing):
    path = packing.tokenizer_file()
    rows = packing.pack(docs, path, capacity=256, slack=2).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, text, *_ in corpus:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.05 * total / 256 + 2
    assert packing.pack(nothing, path).count() == 0


def test_best_fit_takes_the_fullest_bin():
    place = packing.best_fit(np.array([6, 5, 4, 4, 3, 2]), 10)
    assert len(set(place.tolist())) == 3 and place[0] == place[2]


def test_word_tokens_equal_the_tokenizer():
    tokens = wordtokens.WordTokens(packing.tokenizer_file(), 1)
    rng = random.Random(3)
    signs = [*"aBcdE.,,.'st ve'll\t\n\x0b\x1c\x85 éÉßñÑ÷éΣςσİıK日本🙂12x—…", "<|endoftext|>", "<|ENDOFTEXT|>", "'s"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    ids, first = tokens.ids([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_token_counts_equal_the_unigram_tokenizer(spark, docs, nothing):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.vocabulary_of(packing.tokenizer_file("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, True))
    split = pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)])
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab éß日本🙂<0x41>▁athe 'ing") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r["n_tokens"] for r in tokencount.count_tokens(frame, vocabulary).collect()}
    assert found == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(nothing, vocabulary).count() == 0
    assert tokencount.count_tokens(docs, vocabulary).count() == docs.count()


def test_token_counts_of_two_vocabularies(spark):
    """Vocabularies that begin alike and have as many pieces are told apart in one worker."""
    head = [(f"<{i}>", -9.0) for i in range(80)] + [(c, -8.0) for c in "▁abc"]
    one, two = head + [("▁abc", -1.0)], head + [("▁cba", -1.0)]
    frame = spark.createDataFrame([(1, "abc abc")], "doc_id long, text string").coalesce(1)
    assert [tokencount.count_tokens(frame, v).first()["n_tokens"] for v in (one, two, one)] == [2, 8, 2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train(docs)).join(docs.selectExpr("doc_id AS id", "lang"), "id").where(language.held_out("id"))
    right, n = found.selectExpr("count_if(lang = lang_pred)", "count(lang)").first()
    assert n > 200 and right >= 0.98 * n


def test_warc_round_trip(spark):
    page = '<html lang="FR"><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<br>two &lt;3</p><script>no</script><a href="/x?a=1&amp;b=2">go</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/x", page), (2, None, None), (3, "u", ""), (1, "http://a.example/x", page)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses_of(pages)).collect()
    assert len(rows) == 8
    data = b"".join(warc.serialise(r["header"], r["block"].encode()) for r in rows)
    for r, (head, block) in zip(rows, warc.parse(data), strict=True):
        assert block.decode() == r["block"] and head["WARC-Refers-To"] == r["refers_to"] and head["WARC-Block-Digest"] == warc.digest(block)
        assert head["WARC-Type"] == r["warc_type"] and head.get("WARC-Target-URI") == r["target_uri"]
        assert head["X-Source-Payload-Digest"] == r["source_payload_digest"]
    one = {r["warc_type"]: r for r in rows if r["id"] == 1}
    assert one["conversion"]["block"] == "One\ntwo <3\ngo"
    assert one["metadata"]["block"].split("\r\n")[:3] == ["title: A & B", "language: fr", "outlink: /x?a=1&b=2"]
    assert one["conversion"]["source_payload_digest"] == warc.digest(page.encode())
    assert one["metadata"]["block"].split("\r\n")[3:5] == ["http-status: HTTP/1.1 200 OK", "http-content-type: text/html; charset=utf-8"]
    assert warc.derive(warc.responses_of(pages.limit(0))).count() == 0


class PlainReader(HTMLParser):
    """The same reading of well-formed pages by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.fields, self.hidden, self.title, self.lang = [], [], [], None, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        self.lang = self.lang or (attrs.get("lang") if tag == "html" else None)
        if not self.hidden:
            self.fields += [("outlink", " ".join((attrs["href"] or "").split()))] if tag == "a" and "href" in attrs else []
            self.text += ["\n"] if tag in warc.BLOCKS else []
        if tag in warc.HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.text += ["\n"] if tag in warc.BLOCKS and not self.hidden else []

    def handle_data(self, data):
        if self.hidden[-1:] == ["title"]:
            self.title = " ".join(data.split()) if self.title is None else self.title
        elif not self.hidden:
            self.text.append(data)

    def read(self):
        lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(self.text).split("\n"))
        head = [("title", self.title)] * (self.title is not None) + [("language", (self.lang or "").lower())] * bool(self.lang)
        return "\n".join(x for x in lines if x), head + self.fields


def test_pages_read_as_by_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {(r["page_id"], r["warc_type"]): r for r in warc.op9(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 2 * len(rows)
    for r in rows:
        text, fields = PlainReader(r["html"] or "").read()
        assert found[r["page_id"], "conversion"]["block"] == text
        own = [tuple(x.split(": ", 1)) for x in found[r["page_id"], "metadata"]["block"].split("\r\n") if x and not x.startswith("http-")]
        assert own == fields
        assert found[r["page_id"], "metadata"]["source_payload_digest"] == warc.digest((r["html"] or "").encode())


def test_broken_and_long_pages():
    began = time.perf_counter()
    for part in ("<a ", "<", "</", "<!--", "<a x='", "<svg>", "<script>", "<title>", "<a href=\"", "&", "</p", "<p>", "<a b=", "< /", "<![CDATA[", "<template><p>"):
        warc.read_page(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 16
    assert warc.read_page("a < b <p title='x > y'>c</p><br/>d<!-- e -->f")[0] == "a < b\nc\ndf"
    assert warc.read_page("<P>a<SCRIPT>if (a<b) </SCRIPT >b<textarea>&lt;i></textarea>")[0] == "ab<i>"
    assert warc.read_page("x<svg><title>no</title></svg><title>yes</title>")[1] == [("title", "yes")]


def test_source_headers_and_digests_are_preserved(spark):
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nSet-Cookie: a=1;\r\n  b=2\r\nServer: x\r\n\r\n"
    own = "WARC/1.1\r\nWARC-Type: response\r\nWARC-IP-Address: 192.0.2.1\r\nWARC-Payload-Digest: sha1:GIVEN\r\n\r\n"
    rows = [(1, "<urn:uuid:1>", "http://a", "2020-01-01T00:00:00Z", http, "<p>x", own, "clash"), (None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, record_id string, target_uri string, warc_date string, http_header string, payload string, warc_header string, block string")
    found = {(r["id"], r["warc_type"]): r for r in warc.derive(frame).collect()}
    one = found[1, "metadata"]
    assert one["source_payload_digest"] == "sha1:GIVEN" and one["source_block_digest"] == warc.digest(http.encode() + b"<p>x")
    assert one["block"].split("\r\n")[:4] == ["http-status: HTTP/1.1 404 Not Found", "http-content-type: text/html", "http-set-cookie: a=1; b=2", "http-server: x"]
    assert "source-warc-ip-address: 192.0.2.1" in one["block"] and "WARC-IP-Address: 192.0.2.1" in one["header"]
    assert found[None, "conversion"]["block"] == "" and "Refers-To" not in found[None, "conversion"]["header"]


def plain_posteriors(e, t):
    e, a = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12, np.exp(t - t.max())
    f, x = [], np.full(e.shape[1], 1 / e.shape[1])
    for row in e:
        x = (x @ a) * row
        x /= x.sum()
        f.append(x)
    g, out = np.ones(e.shape[1]), []
    for i in range(len(e) - 1, -1, -1):
        out.append(f[i] * g)
        g = a @ (e[i] * g)
        g /= g.sum()
    out = np.array(out[::-1])
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_over_chunks():
    rng = np.random.default_rng(0)
    count = np.array([0, 1, 63, 64, 65, 300])
    e, t = rng.standard_normal((count.sum(), 3)) * 3, rng.standard_normal((3, 3))
    p, _ = language.posteriors(e, t, count)
    ends = np.cumsum(count)
    for end, n in zip(ends, count):
        if n:
            assert np.allclose(p[end - n : end], plain_posteriors(e[end - n : end], t))


def test_languages_are_told_apart(spark, nothing):
    rng = random.Random(0)
    bank = {"aa": ["ka", "tor", "mi", "zul"], "bb": ["esh", "ver", "lon", "pi"]}
    say = lambda k, n: " ".join("".join(rng.choice(bank[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say("ab"[i % 2] * 2, 40), "ab"[i % 2] * 2, "x", 9.0) for i in range(120)]
    rows += [(500, None, "aa", "x", 1.0), (501, "12 !!", None, "x", 1.0), (502, say("aa", 90) + " " + say("bb", 10), None, "x", 1.0), (503, "—… ½ ½ ②", None, "x", 1.0)]
    rows += [(600 + i, "qu" + "ox " * 30, "cc", "x", 1.0) for i in range(3)]  # a rare language
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    model = language.train(frame, sample_docs=60)
    found = {r["id"]: r for r in language.identify(frame, model).collect()}
    truth = {r[0]: r[2] for r in rows[:120]}
    assert all(found[i]["lang_pred"] == t for i, t in truth.items())
    assert all(found[i]["lang_pred"] == "cc" for i in range(600, 603))
    assert [found[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "aa", "und"]
    assert 0.8 < found[502]["score"] <= 1
    kept = language.keep_identified(frame, model)
    assert kept.columns == frame.columns and kept.count() == 124
    assert kept.where("doc_id = 502").first()["lang"] == "aa"
    empty = frame.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        stage(spark, at, "").write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert at.columns == before.columns
    assert at.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert json.dumps(at.columns)


def test_pipeline_stages_do_their_work(spark, docs):
    """Each stage judged on its own input by plain sets, counts and the tokenizer."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    at = docs.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id", "text"])
    step = lambda name, rows: [r.asDict() for r in stages[name](spark, rows, "").collect()]
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in at.columns) for r in rows], at.schema)
    named = step("language", at)
    assert all(r["lang"] and any(c.isalpha() for c in r["text"]) for r in named)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    once = step("near_dedup", frame(named))
    sets = [(r["doc_id"], shingles(r["text"])) for r in once]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, (_, a) in enumerate(sets) for _, b in sets[:i])
    left = {r["doc_id"] for r in once}
    for r in named:  # what went is near something that stayed with a smaller id
        if r["doc_id"] not in left:
            own = shingles(r["text"])
            assert any(i < r["doc_id"] and 100 * len(own & s) >= 80 * len(own | s) for i, s in sets)
    cut = step("substring_dedup", frame(once))
    firsts: dict = {}
    for r in sorted(once, key=lambda r: r["doc_id"]):
        w = r["text"].split()
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {i + k for i, x in enumerate(runs) if firsts.get(x, r["doc_id"]) < r["doc_id"] for k in range(50)}
        for x in runs:
            firsts.setdefault(x, r["doc_id"])
        found = [c for c in cut if c["doc_id"] == r["doc_id"]]
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert [c["text"].split() for c in found] == ([kept] if kept else [])
    mixed = step("mixture", frame(cut))
    sizes: dict = {}
    for r in cut:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = mixture.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, wanted):
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == s) - t) <= 0.5
    packed = step("packing", frame(mixed))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    assert sum(p["length"] for p in packed) == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)


def test_every_response_has_record_ids_of_its_own(spark):
    rows = [(1, None, "http://a", "d", "<p>one"), (2, None, "http://a", "d", "<p>two"), (3, None, "http://b", "d", "<p>one"), (4, "<urn:x>", "http://a", "d", "<p>one"), (5, "<urn:x>", "http://a", "d", "<p>two"), (6, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, record_id string, target_uri string, warc_date string, payload string").selectExpr("*", "cast(null as string) AS http_header")
    heads = [next(iter(warc.parse(warc.serialise(r["header"], r["block"].encode()))))[0] for r in warc.derive(frame).collect()]
    assert len({h["WARC-Record-ID"] for h in heads}) == 12
    again = [r["header"] for r in warc.derive(frame).collect()]
    assert sorted(again) == sorted(r["header"] for r in warc.derive(frame.repartition(3)).collect())
    pages = spark.createDataFrame([(1, "http://a", "<p>one"), (1, "http://a", "<p>two")], "page_id long, url string, html string")
    assert len({r["header"].split("WARC-Record-ID: ")[1].split("\r\n")[0] for r in warc.derive(warc.responses_of(pages)).collect()}) == 4
