"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from stratalog.llm import ann, bpe, licenses, mixing, neardup, pii, quality, rules, shards, urls

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
BOOK = "the quick brown fox jumps over the lazy dog and runs far away from here"
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, BOOK, "en", "a"),
    (4, BOOK, "en", "a"),
    (5, BOOK.upper(), "en", "b"),
    (6, LONG, "en", None),
    (None, "no id here mit license", None, "b"),
    (7, "one two", "en", "b"),
    (8, "one two", "de", "b"),
    (9, "mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111 " + BOOK, "en", "b"),
    (10, "9" * 5000 + "@" * 50 + "1." * 3000 + " 😀 é ÉÉ", "en", "c"),
]


@pytest.fixture(scope="module")
def table(spark):
    """The rows with columns whose names the operators might use themselves."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = ("_text", "_key", "_base", "row", "words", "ref_lang", "mix_source", "threshold", "band", "node", "k", "ids", "a.b", "n_chars")
    return rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="module")
def empty(table):
    return table.where("false")


def test_rules(table, empty):
    found = rules.quality_rules(table)
    assert found.columns == [*table.columns, "rules"]
    by = {(r.doc_id, r.source): r.rules for r in found.collect()}
    assert found.count() == len(ROWS)
    assert by[1, None].n_words == 0 and by[1, None].base_failed and by[6, None].n_words == 60_000 and by[6, None].kept
    assert rules.quality_rules(empty).collect() == []


def test_rules_store_no_text(table, monkeypatch):
    """Only sums by language are stored, and they are those of the documents' own histograms."""
    stored, materialize = [], rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df: stored.append(materialize(df)) or stored[-1])
    assert rules.quality_rules(table).count() == len(ROWS)
    assert all({c.partition("_")[0] for c in df.columns} == {"ref"} for df in stored)
    each, sums = rules.measured(table.select("lang", "text"), stored[-1]).collect(), {}
    for r in each:
        if r.rules.words:
            kept = sums.setdefault(r.lang, (np.zeros(len(r.rules.words)), np.zeros(len(r.rules.classes))))
            kept[0][:] += r.rules.words
            kept[1][:] += r.rules.classes
    got = {r.ref_lang: (r.ref_words, r.ref_classes, r.ref_total) for r in stored[-1].collect()}
    for lang, (words, classes) in sums.items():
        assert got[lang] == (list(words), list(classes), sum(words))


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h", "x " * 100, BOOK + "\n" + BOOK + " z", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", rules.words_of(F.col("text")))
    got = [r[0] for r in frame.select(rules.repeated_words(F.col("w"))).collect()]

    def plain(t):
        w = t.split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        return len({i + j for s in seen.values() if len(s) > 1 for i in s for j in range(8)})

    assert got == [plain(t) for t in texts]


def test_mixing(table, empty):
    got = mixing.mix(table)
    assert got.columns == [*table.columns, "mix"] and got.count() == len(ROWS)
    assert all(r.mix.taken in (0, r.mix.size, 2 * r.mix.size) for r in got.collect())
    assert mixing.mix(empty).collect() == [] and mixing.mixed(table).columns == table.columns
    assert mixing.mix(table.where("text is null")).collect()[0].mix.taken == 0


def test_mixing_takes_repeats(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).groupBy("source").agg(F.sum("mix.taken").alias("t"), F.first("mix.target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 50 for r in got)
    assert mixing.mixed(frame).count() == mixing.mix(frame).agg(F.sum(F.col("mix.taken") / F.col("mix.size"))).first()[0]


def test_personal_data(table, empty):
    got = pii.personal_data(table)
    assert got.columns == [*table.columns, "pii"] and got.count() == len(ROWS)
    nine = got.where("doc_id = 9").withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).first()
    assert [pii.KINDS[s.rank] for s in nine.pii.base] == ["email", "phone", "ip", "card"]
    assert nine.clean.startswith("mail [EMAIL] or [PHONE], [IP], [CARD] the quick")
    assert pii.personal_data(empty).collect() == []


def test_disclosing_terms(spark):
    rows = [(i, f"plain words number{i} stand here and nothing else {i}") for i in range(60)]
    rows += [(100 + i, f"report {i} by director zzyzx write to boss@corp.example.com about item{i}") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.personal_data(frame).where("doc_id >= 100").withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).collect()
    for r in got:
        terms = {r.text[s.start : s.end] for s in r.pii.added}
        assert "zzyzx" in terms and "director" in terms and f"item{r.doc_id - 100}" not in terms
        assert "zzyzx" not in r.clean and "[EMAIL]" in r.clean
    copies = spark.createDataFrame([(i, "one rareword writes to me@home.example.org") for i in range(9)] + rows[:60], "doc_id long, text string")
    assert all(not r.pii.added for r in pii.personal_data(copies).collect())


def test_disclosing_terms_of_groups(spark):
    far = " ".join(f"filler{k}" for k in range(300))
    rows = [(i, f"plain words number{i} stand here {far}") for i in range(60)]
    rows += [(100 + i, f"Zzyzx {far} person{i}@corp.example.com {far} zzyzx end{i}") for i in range(5)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).collect()
    for r in got:
        assert [r.text[s.start : s.end] for s in r.pii.added] == ["Zzyzx", "zzyzx"]
        assert "zzyzx" not in r.clean.lower() and "[EMAIL]" in r.clean


def test_disclosing_terms_of_the_shipped_tables(spark):
    got = pii.personal_data(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = got.where("size(pii.added) > 0").collect()
    assert found
    for r in found:
        terms = {r.text[s.start : s.end].lower() for s in r.pii.added}
        inside = lambda m: any(b.start < m.end() and m.start() < b.end for b in r.pii.base)
        words = [m for m in re.finditer(r"[^\W_]+", r.text) if m[0].lower() in terms and not inside(m)]
        assert [(m.start(), m.end()) for m in words] == [(s.start, s.end) for s in r.pii.added]


def plain_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(table, empty):
    path, encoding = P.path("byte_bpe_50k.tiktoken"), plain_encoding()
    got = bpe.digests(table, path, P.PATTERN).collect()
    wanted = sorted((hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, _, _ in ROWS)
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in got) == wanted
    assert bpe.digests(empty, path, P.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(table, path, P.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _, _ in ROWS)


def test_bpe_long_and_odd_pieces():
    encoding, own = plain_encoding(), bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.choice([32, 97, 98, 233, 0x4E2D, 0x1F600, 33, 10, 48], n)) for n in rng.integers(0, 400, 200)]
    texts += [" " * 3000, "ab" * 4000, "!" * 2500, "<|endoftext|>", "a\x1c\x85 b"]
    assert [list(map(int, ids.split())) for ids in own.texts(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_shards(spark, table, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = shards.new_folder(spark)
    manifest = shards.write_shards(table, path, folder, file_tokens=100, range_documents=4)
    got = sorted(shards.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t, _, _ in ROWS)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    other = shards.new_folder(spark)
    assert shards.read_shards(shards.write_shards(empty, path, other), other).collect() == []


def test_encoder():
    """Array cuts, odd stretches and added tokens give the library's ids, however texts are grouped."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), shards.Encoder(path)
    some = ["a", "B", "é", "É", "×", "÷", "ß", "Þ", "'", "'s", "'T", "'RE", " ", "\n", "  ", "\t", "\x85", "\xa0", "7", "42", "²", "µ", "¿", ".", "!?", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext|>", "İ", "ſ", "Ⱥ", "ž", "e\u0301", "h\u0331", "H\u0331", "Привет", "漢字", "😀", "’", "\x00", "\x7f", "\xad", "The", "STRASSE"]
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "\n", "x" * 70_000, *("".join(rng.choice(some, n)) for n in rng.integers(1, 14, 3000)), *(f"a{chr(c)}B {chr(c)}" for c in range(0x300))]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for size in (len(texts), 7):
        got = [x for at in range(0, len(texts), size) for x in own.encode(pa.array(["'s", *texts[at : at + size]], pa.string()).slice(1), 1).to_pylist()]
        assert [np.frombuffer(x, own.kind).tolist() for x in got] == want


def test_encoder_speed():
    """Known words, in any case and with any signs, cost less than to split texts and look each stretch up in Python."""
    own, rng = shards.Encoder(P.path("word_bpe_49k.json")), np.random.default_rng(8)
    words = ["".join(x) for x in rng.choice(list("aeinorst"), (20_000, 7))]
    texts = [" ".join((w.title() if a else w) + ("," if b else "") for w, a, b in zip(rng.choice(words, 200).tolist(), rng.random(200) < 0.1, rng.random(200) < 0.1)) for _ in range(3000)]
    column, known = pa.array(texts), {}

    def plain():
        split = [t.split(" ") for t in texts]
        known.update((s, s.encode()) for s in set().union(*split).difference(known))
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def best(run):
        run()
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert best(lambda: own.encode(column, 1)) < best(plain)


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 300, 2000).astype(np.uint16)
    data = shards.dump_shard(np.arange(1), np.ones(1), np.array([2000]), values, 16)
    matrix = shards.load_shard(data)[3]
    assert (matrix.decode() == values).all()
    for i in rng.integers(0, 2000, 30).tolist():
        c = int(values[i])
        assert matrix.access(i) == c and matrix.rank(c, i) == int((values[:i] == c).sum())
        assert matrix.select(c, matrix.rank(c, i)) == i
    assert matrix.select(299, 10**6) == -1 and matrix.rank(1000, 2000) == 0
    with pytest.raises(ValueError):
        shards.load_shard(data[:-1] + b"\0\1")


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://X.COM"), (4, "http://a.net/es/1?q#f"), (4, "http://a.net/es/1?q#f"), (5, "https://www.Example.com/en/x"), (6, "http://q.org/a//b/c/d/e/f/g/h"), (None, "http://b.example.com/en/")]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("shape", F.lit(1)).withColumn("verdict", F.lit("?"))
    got = {(r.page_id, r.host): r for r in urls.url_filter(frame).collect()}
    assert got[1, ""].path == "" and got[2, ""].rule is None and got[3, "x.com"].rule is None
    assert got[4, "a.net"].rule == "net/es/" and got[5, "www.example.com"].verdict == "allow" and got[None, "b.example.com"].verdict == "block"
    assert urls.url_filter(frame).count() == len(rows) and urls.url_filter(frame.where("false")).collect() == []


def test_url_templates(spark):
    """A host whose labelled pages below one branch are all blocked loses the others of that branch, and only those."""
    rows = [(i, f"http://h.org/bad/{i}", "block" if i < 20 else None) for i in range(30)] + [(100 + i, f"http://h.org/good/{i}", "allow" if i < 20 else None) for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, label string")
    got = {r.page_id: r.verdict for r in urls.url_filter(frame, label="label", rules=()).collect()}
    assert all((v == "block") == (i < 100) for i, v in got.items())


def test_licenses(table, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(table).collect()}
    assert got[None].base_labels == "mit" and got[None].first_word == 3 and got[6].n_words == 60_000
    assert got[1].labels == "" and got[1].first_word is None and licenses.scan_licenses(empty).collect() == []


def plain_licenses(text):
    """Labels by the rule's own words: all mandatory phrases stand, each begin of the template within the drift of the first."""
    words = licenses.words_of(text)
    places = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    labels = {label for p, label in licenses.PHRASES.items() if places(p.split())}
    for t in licenses.TEMPLATES:
        own = licenses.words_of(t.text)
        begins = [[at - licenses.position(own, p.split()) for at in places(p.split())] for p in t.mandatory]
        drift = max(licenses.DRIFT, int(licenses.DRIFT_SHARE * len(own)))
        if any(all(any(low <= b <= low + drift for b in some) for some in begins) for low in {b for some in begins for b in some}):
            labels.add(t.label)
    return labels


def test_license_templates(spark):
    rng = np.random.default_rng(5)
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "x1", "copy", "all"], n))
    texts = {i: filler(30) + " " + t.text + " " + filler(20) for i, t in enumerate(licenses.TEMPLATES)}
    texts[100] = "\n".join(t.text for t in licenses.TEMPLATES)
    texts[101] = "the software is provided as is without warranty of any kind"  # not a mandatory phrase
    for i, t in enumerate(licenses.TEMPLATES):  # cut, doubled, with a word in a phrase changed, with the phrases far apart
        words = t.text.split()
        texts[200 + i] = " ".join(words[: len(words) // 2])
        texts[300 + i] = t.text + filler(5) + t.text
        texts[400 + i] = t.text.lower().replace(t.mandatory[-1].split()[-1], "other")
        texts[500 + i] = (" " + filler(400) + " ").join(t.mandatory)
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        assert set(filter(None, got[i].labels.split(","))) == plain_licenses(text), text
    assert all(t.label in got[i].labels.split(",") and got[i].score == pytest.approx(1.0) for i, t in enumerate(licenses.TEMPLATES))
    assert got[101].labels == "" and got[101].score == 0 and len({t.label for t in licenses.TEMPLATES}) >= 10


def test_classifier(spark, table, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 1, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, quality.fit(table, labels))
    assert got.count() == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    assert quality.classify(empty, quality.fit(empty, labels.where("false"))).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)).round(3)
    rows = [(i, base[i].tolist(), 1) for i in range(300)]
    rows += [(1000 + i, base[20].tolist(), 2) for i in range(60)]  # copies of one vector
    rows += [(20, base[20].tolist(), 3), (2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] + [1.0] * 7, 0), (2060, [None] + [1.0] * 7, 0), (2080, [1.0, 2.0], 0), (None, base[3].tolist(), 0), (2100, [float("inf")] + [1.0] * 7, 0)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("shard", T.IntegerType())]))
    got = ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, k=5).collect()
    vectors = {i: np.array(v) for i, v, _ in rows if i is not None and i < 2000 and v is not None}
    hits = total = 0
    for q in (i for i in vectors if i % 20 == 0):
        order = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == 5
        hits += len(set(mine) & {i for _, i in order})
        total += 5
    assert hits >= 0.95 * total and {r.query_id for r in got} <= set(vectors)
    twenty = [r.vec_id for r in sorted((r for r in got if r.query_id == 1000), key=lambda r: r["rank"])]
    best = sorted((-float(vectors[1000] @ v), i) for i, v in vectors.items() if i != 1000)[:5]
    assert twenty == [i for _, i in best]
    assert ann.nearest_neighbours(frame.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert len(ann.nearest_neighbours(frame.where("vec_id in (20, 21)"), F.col("vec_id") == 20).collect()) == 1


def test_near_duplicates(table, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(table).collect()}
    assert got[5].component_id == 4 and got[8].component_id == 7 and got[7].n_shingles == 1
    assert got[1].kept and got[1].n_shingles == 0 and got[2].component_id == 2 and got[3].kept
    assert neardup.near_duplicates(table).count() == len(ROWS) and neardup.near_duplicates(empty).collect() == []
    assert neardup.deduplicated(table).columns == table.columns


def test_near_duplicates_hot_group(spark):
    """A large group of near copies, small blocks: components as by comparing all pairs."""
    from .test_queries import plain_components

    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in rng.integers(0, 5000, 150)]
    texts = {}
    for i in range(260):
        words = list(base)
        for _ in range(rng.integers(0, 9)):
            words[rng.integers(0, len(words))] = f"u{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    for i in range(260, 320):
        texts[i] = " ".join(f"t{x}" for x in rng.integers(0, 5000, rng.integers(3, 400)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, small=8, block=64).collect()}
    assert got == plain_components(texts)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_group_below_the_threshold(spark, monkeypatch, percent):
    """Many near copies just below the threshold: candidates grow with the nodes, links as by comparing all pairs."""
    from .test_queries import plain_components

    rng, m = np.random.default_rng(5), 400
    base = [f"t{i}" for i in range(200 if percent == 85 else 150)]
    texts = {}
    for i in range(m):
        words = list(base)
        for at in rng.choice(len(base), 3 if i % 20 else 1, replace=False):
            words[at] = f"u{i}x{at}"
        texts[i] = " ".join(words)
    counts, settle = [], neardup.Search.settle
    monkeypatch.setattr(neardup.Search, "settle", lambda self, candidates: (counts.append(candidates.count()), settle(self, candidates))[1])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, percent=percent).collect()}
    assert got == plain_components(texts, percent) and len({c for _, c in got.values()}) > m / 8
    assert max(counts) < 48 * m / 2, counts


def test_repeated_ids_link_their_texts(spark):
    """Two texts under one id are both of that id; a large group of copies is one class."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(10, a), (10, b), (11, a + " x"), (12, b + " y"), (13, "alone")] + [(1000 + i, BOOK) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    assert (got[10], got[11], got[12], got[13]) == (10, 10, 10, 13) and {got[1000 + i] for i in range(200)} == {1000}
    assert sorted(r.doc_id for r in neardup.deduplicated(frame).collect()) == [10, 13, 1000]


def test_groups_are_found_from_firsts(spark, monkeypatch):
    """Groups of nodes that share buckets take links between the firsts of buckets, not one for each node in each bucket."""
    met, components = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: met.append(links.count()) or components(links))
    # buckets 0, 1, 2 hold nodes 0-99, bucket 3 nodes 100-139, bucket 4 nodes 139-199 and so ties in bucket 3's; each node is a part of its own
    buckets = [(b, range(100), b) for b in range(3)] + [(3, range(100, 140), 100), (4, range(139, 200), 150)]
    rows = [(b, i, 10, first, len(nodes), i) for b, nodes, first in buckets for i in nodes]
    apart = spark.createDataFrame(rows, "band long, node long, n long, first long, nodes long, part long")
    search = neardup.Search(None, None, spark.createDataFrame([], "a long, b long"), 80, 48, 512, 256)
    few, many = search.dealt(apart)
    got = sorted((r.whole, r.key, r.node) for r in many.collect())
    # the first group has fewer pairs than its buckets and goes as a whole; the second by its large bucket
    assert got == [*((False, 4, i) for i in range(139, 200)), *((True, 0, i) for i in range(100))]
    assert sorted((r.band, r.node) for r in few.collect()) == [(3, i) for i in range(100, 140)]
    assert {tuple(sorted(r.nodes)) for r in few.groupBy("group").agg(F.collect_set("node").alias("nodes")).collect()} == {tuple(range(100, 140))}
    assert len(met) == 1 and met[0] <= 6


def test_rounds_see_merged_links(spark, monkeypatch):
    """Components of stars, chains and loops; the rounds get the links between merged nodes alone."""
    seen, spread = [], neardup.spread
    monkeypatch.setattr(neardup, "spread", lambda edges, labels: seen.append(edges.count()) or spread(edges, labels))
    rng = np.random.default_rng(5)
    pairs = [(0, i) for i in range(1, 200)] + [(i, j) for i in range(100, 130) for j in range(100, 130)]  # a star, its leaves linked too
    pairs += [(300 + i, 301 + i) for i in range(20)] + [(400, 400)] + [(500 + int(x), 500 + int(y)) for x, y in rng.integers(0, 60, (40, 2))]
    want = {n: n for p in pairs for n in p}
    for _ in want:
        for x, y in pairs:
            want[x] = want[y] = min(want[x], want[y])
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert len(seen) == 1 and seen[0] <= 2 * (20 + 40)
    assert {tuple(r) for r in neardup.components(spark.createDataFrame(pairs[:229], "a long, b long")).collect()} == {(i, 0) for i in range(200)} and len(seen) == 1


def test_collision_correction():
    """Registers of disjoint sets agree about as often as predicted."""
    rng = np.random.default_rng(1)
    for n, bits in ((100, 0), (1000, 4), (200, 8)):
        equal = np.mean([np.mean(neardup.registers(rng.integers(0, 2**63, n).astype(np.uint64), bits) == neardup.registers(rng.integers(0, 2**63, n).astype(np.uint64), bits)) for _ in range(30)])
        assert abs(equal - neardup.chance(n, n, bits)) < 0.002


def test_near_duplicates_at_80(spark):
    assert neardup.band_width(85) == 6 and neardup.classes(85) == neardup.CLASSES
    for percent in (60, 80, 85, 95):
        assert (1 - (percent / 100) ** neardup.band_width(percent)) ** (256 // neardup.band_width(percent)) <= 1e-8
        for large in [*range(2, 700), *range(3000, 8000)]:
            small = -(-percent * large // 100)
            assert set(neardup.classes_of(small, percent)) & set(neardup.classes_of(large, percent)), (percent, small, large)
    # one text is the other's beginning: 0.82 of its shingles in each case, in the last across the second and third class
    rows = []
    for k, n in enumerate((50, 300, 4100)):
        words = [f"v{k}x{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: -(-82 * n // 100) + 4]))]
    rows += [(6, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "length(text) as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == [0, 2, 4, 6]
