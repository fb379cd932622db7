"""The opN queries against plain versions, on a whole small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from stratalog.llm import bpe, licenses, mixing, pii, queries, rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, sf, name, key="doc_id"):
    return {r[key]: r.asDict() for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def water(sizes):
    """Targets by the rule's own words: reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def test_op1(spark, sf, documents):
    got = rows(spark, sf, "op1_mix_sources")
    size = {i: len(WORD.findall(d.text or "")) for i, d in documents.items()}
    sizes = Counter()
    for i, d in documents.items():
        sizes[d.source] += size[i]
    targets = water(sizes)
    taken, largest = Counter(), Counter()
    assert got.keys() == documents.keys()
    for i, d in documents.items():
        assert got[i]["size"] == size[i] and got[i]["source_size"] == sizes[d.source]
        assert got[i]["target"] == pytest.approx(targets[d.source], rel=1e-9)
        assert got[i]["taken"] in (0, size[i], 2 * size[i])
        taken[d.source] += got[i]["taken"]
        largest[d.source] = max(largest[d.source], size[i])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    assert got == rows(spark, sf, "op1_mix_sources")


def test_op2(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    held = [(r.score, r.quality, r.predicted) for r in got.where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert good and bad
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.9
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, _, p in held)
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0


def test_op2_against_plain_votes(spark):
    """Scores are similarity-weighted votes of the nearest labelled texts, one text at a time with exact cosines."""
    from stratalog.llm import quality

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(model.labels.tolist()) == sorted(float(y) for i, y in known.items() if i in texts)
    for i, text in texts.items():
        v = model.project(quality.features(text)[None, :])[0].astype(np.float64)
        cosines = np.array([float(v @ w) for w in model.vectors.astype(np.float64)])
        near = np.sort(np.argsort(-cosines)[: quality.NEIGHBOURS])
        weight = np.maximum(cosines[near], 0) ** quality.SHARPNESS
        score = (weight * model.labels[near]).sum() / weight.sum() if text and weight.sum() else model.prior
        assert got[i].score == pytest.approx(score, abs=1e-3), i
        assert got[i].predicted == (got[i].score >= 0.3)


def test_op3(spark, sf, documents):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows(spark, sf, "op3_byte_bpe")
    for i, d in documents.items():
        ids = encoding.encode_ordinary(d.text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_op4_terms(spark):
    """Disclosing terms by counting pairs of every entity group and word over all documents."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 60, rng.integers(3, 25))]
        if i % 9 == 0:
            words += [f"p{i % 4}@corp{i % 3}.example", f"code{i % 3}"]
        if i % 31 == 0:
            words += ["10.0.0.%d" % (i % 7), "router"]
        rows.append((i, None if i % 97 == 1 else " ".join(words)))
    rows += [(1000 + i, rows[9][1]) for i in range(5)]  # copies make no support
    got = {r.doc_id: r.pii for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = {i: t or "" for i, t in rows}
    base = {i: plain_spans(t) for i, t in texts.items()}

    def groups(value, rank):
        value = value.lower()
        more = [("local", value.split("@")[0]), ("domain", value.split("@")[-1])] if rank == 0 else [("net", ".".join(value.split(".")[:3]))] if rank == 1 else [("prefix", re.sub("[^0-9]", "", value)[: pii.PREFIX])]
        return {(rank, "kind", ""), (rank, "value", value), *((rank, *m) for m in more)}

    def terms(text, spans):
        for a, _, b, _ in reversed(spans):
            text = text[:a] + " " + text[b:]
        return set(re.findall(r"[^\W_]+", text.lower()))

    entities = {i: set().union(*(groups(texts[i][a:b], rank) for a, rank, b, _ in base[i])) for i in texts if base[i]}
    with_entity, with_term, both, distinct, alone = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for i, text in texts.items():
        with_term.update(set(re.findall(r"[^\W_]+", text.lower())))
        for e in entities.get(i, ()):
            with_entity[e] += 1
            alone[e].add(text)
            for t in terms(text, base[i]):
                both[e, t] += 1
                distinct[e, t].add(text)
    share = {}
    for (e, t), n in both.items():
        if len(distinct[e, t]) >= pii.SUPPORT and with_entity[e] < len(texts):
            share[e, t] = np.log(n * len(texts) / (with_entity[e] * with_term[t])) / np.log(len(texts) / with_entity[e])
    for i, text in texts.items():
        wanted = {}
        for t in terms(text, base[i]) if base[i] else ():
            top = max((share.get((e, t), 0) for e in entities[i]), default=0)
            if top >= pii.GENERALISE:
                wanted[t] = "remove" if top >= pii.REMOVE else "generalise"
        spans = [(m.start(), m.end(), wanted[m[0].lower()]) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in wanted and not any(a < m.end() and m.start() < b for a, _, b, _ in base[i])]
        assert [(s.start, s.end, s.value) for s in got[i].added] == spans, i
    assert any(p.added for p in got.values())


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.A):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_op4(spark, documents, sf):
    got = rows(spark, sf, "op4_personal_data")
    for i, d in documents.items():
        spans = plain_spans(d.text or "")
        shown = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert Counter(k for *_, k in spans) == Counter({k: got[i][f"n_{k}"] for k in BASE if got[i][f"n_{k}"]})
        assert set(shown) <= set(got[i]["spans"].split(","))


def test_op5(spark, sf, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, start = rows(spark, sf, "op5_token_shards"), 0
    for i in sorted(documents):
        ids = tokenizer.encode(documents[i].text or "", add_special_tokens=False).ids + [1]
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, dtype="<u4").tobytes())}
        start += len(ids)


VARIABLE = re.compile(r"[0-9][^a-zA-Z]*(?:\.[a-z]+)?|[0-9a-fA-F-]{16,}|.*[0-9].*[0-9].*[0-9].*|.{40,}", re.S)


def plain_templates(pages):
    """{page: (template, purity)} by the module's rules, from {page: (host, path, label)}."""
    shapes = {i: (h, tuple("*" if VARIABLE.fullmatch(s) else s for s in p.split("/") if s)) for i, (h, p, _) in pages.items()}
    stats = defaultdict(lambda: [0.0, 0.0, 0.0])  # (host, shape): pages, allowed, blocked
    for i, (_, _, label) in pages.items():
        for k, one in enumerate((True, label == "allow", label == "block")):
            stats[shapes[i]][k] += one
    keys = lambda h, s: [("", ""), (1, "", s[0] if s else ""), (2, "", "/".join(s)), *((2 + k, ".".join(h.split(".")[-k:]), "/".join(s)) for k in urls.DOMAINS if len(h.split(".")) > k)]
    pooled = defaultdict(lambda: [0.0, 0.0])
    for (h, s), (_, a, b) in stats.items():
        for key in keys(h, s):
            pooled[key][0] += a
            pooled[key][1] += b
    path = {x: () for x in stats}
    level = 0
    while True:
        nodes = defaultdict(list)
        for (h, s), p in path.items():
            nodes[h, p].append((h, s))
        opened = {k for k, v in nodes.items() if len(v) > 1 and any(stats[x][1] + stats[x][2] for x in v) and max(len(x[1]) for x in v) > level and len(k[1]) == level}
        if not opened:
            break
        for k in opened:
            children = defaultdict(lambda: [0.0, 0.0, 0.0])
            child = lambda x: x[1][level] if len(x[1]) > level else ""
            for x in nodes[k]:
                children[child(x)] = [u + v for u, v in zip(children[child(x)], stats[x])]
            n, a, b = map(sum, zip(*children.values()))
            name = {}
            for c, (_, ca, cb) in children.items():
                many = len(children) > urls.MAX_CHILDREN or len(children) >= urls.FEW_CHILDREN and len(children) > n / 2
                mean = b / (a + b)
                close = 0 < ca + cb < a + b and abs(cb / (ca + cb) - mean) <= urls.SIGNIFICANT * (mean * (1 - mean) / max(ca + cb, 1)) ** 0.5
                name[c] = "" if c == "" else "*" if many or close else c
            for x in nodes[k]:
                path[x] = (*path[x], name[child(x)])
        level += 1
    leaves = defaultdict(lambda: [0.0, 0.0])
    for (h, s), p in path.items():
        leaves[h, p] = [u + v for u, v in zip(leaves[h, p], stats[h, s][1:])]
    out = {}
    for i, (h, s) in shapes.items():
        share = 0.5
        for key in keys(h, s):
            share = (pooled[key][0] + urls.PRIOR * share) / (sum(pooled[key]) + urls.PRIOR)
        a, b = leaves[h, path[h, s]]
        out[i] = "/" + "/".join(x for x in path[h, s] if x), (a + urls.PRIOR * share) / (a + b + urls.PRIOR)
    return out


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(spark, sf, "op6_url_filter", "page_id")
    pages = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[r.page_id]["host"], got[r.page_id]["path"]) == (host, path)
        assert got[r.page_id]["rule"] == (best and best[1])
        pages[r.page_id] = host, path, best and best[2]
    known = plain_templates(pages)
    for i, (_, _, label) in pages.items():
        assert got[i]["verdict"] == (label or ("block" if known[i][1] < urls.REJECT_BELOW else "allow"))
    free = [got[i]["verdict"] for i, (_, _, label) in pages.items() if not label]
    assert "block" in free and "allow" in free  # the tree decides something


def test_url_templates_on_deep_paths(spark):
    rng = np.random.default_rng(4)
    pages = {}
    for i in range(3000):
        host = rng.choice(["a.x.org", "b.x.org", "c.net", "x.org", "q", "w.v.u.t.s.com"])
        path = "/" + "/".join(str(rng.choice(["en", "es", "shop", f"{rng.integers(0, 999)}", f"k{rng.integers(0, 40)}"])) for _ in range(rng.integers(0, 8)))
        odds = 0.9 if "/es" in path else 0.1 if "shop" in path else 0.5
        pages[i] = str(host), path, [None, "block" if rng.random() < odds else "allow"][int(rng.random() < 0.6)]
    frame = spark.createDataFrame([(i, f"http://{h}{p}", label) for i, (h, p, label) in pages.items()], "page_id long, url string, label string")
    got = {r.page_id: (r.template, r.purity) for r in urls.url_filter(frame, label="label", rules=()).collect()}
    wanted = plain_templates(pages)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in wanted.items()}
    assert all(got[i][1] == pytest.approx(p) for i, (_, p) in wanted.items())


def test_op7(spark, sf, documents):
    got = rows(spark, sf, "op7_license_scan")
    for i, d in documents.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), d.text or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        g = got[i]
        assert (g["n_words"], g["n_base"]) == (len(words), len(at))
        assert (g["first_word"], g["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        base = {label for _, label in at}
        assert g["base_labels"] == ",".join(sorted(base)) and base <= set(g["labels"].split(",")) | {""} or not base
        assert 0 <= g["score"] <= 1


def plain_rules(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def test_op8(spark, sf, documents):
    got = rows(spark, sf, "op8_quality_rules")
    for i, d in documents.items():
        wanted = plain_rules(d.text or "")
        assert {k: got[i][k] for k in wanted} == wanted
        assert not (got[i]["kept"] and wanted["base_failed"])
    assert sum(g["kept"] for g in got.values()) > len(got) / 2


def test_op9(spark, sf):
    table = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids, matrix = np.array(list(table)), np.stack(list(table.values()))
    got = queries.op9_nearest_neighbours(spark, sf).collect()
    hits = total = 0
    for q in (i for i in table if i % 20 == 0):
        scores = matrix @ table[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(table[q] @ table[r.vec_id]), rel=1e-12) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({int(ids[i]) for i in order} & {r.vec_id for r in mine})
        total += 20
    assert hits >= 0.9 * total


def plain_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op10(spark, sf, documents):
    got = rows(spark, sf, "op10_near_duplicates")
    wanted = plain_components({i: d.text for i, d in documents.items()})
    assert {i: (g["n_shingles"], g["component_id"]) for i, g in got.items()} == wanted
    assert all(g["kept"] == (i == g["component_id"]) for i, g in got.items())


def test_modules_have_parameters():
    assert mixing.WEIGHTS == (3, 1, 2) and rules.MIN_WORDS == 20 and list(pii.PATTERNS) == list(BASE)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    found = con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in found.description]
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got.collect()) == plain(found.fetchall())
