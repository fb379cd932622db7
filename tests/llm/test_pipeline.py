"""The corpus pipeline on small tables with hard rows, stage by stage against plain versions."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from stratalog.llm import bpe, mixing, pii, rules

from .test_queries import plain_components, water

BOOK = "the quick brown fox jumps over the lazy dog and runs far away from here while the cat sleeps near the old house by the river"
PROSE = [f"{BOOK} chapter {i} tells how traveller {i * 7} met the miller of town {i * 13} and what they said about harvest {i} and rain" for i in range(12)]
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "too short", "en", None, 9),
    *[(10 + i, text, "en", "ab"[i % 2], len(text)) for i, text in enumerate(PROSE)],
    (40, PROSE[0], "en", None, len(PROSE[0])),  # a copy
    (41, PROSE[0], None, "b", len(PROSE[0])),
    (12, PROSE[2], "en", "a", len(PROSE[2])),  # a repeated row
    (50, PROSE[3] + " write to ann.lee@mail.example or 10.1.2.3 today", "en", "b", None),
    (None, BOOK + " nobody knows the id of this text and yet it is long enough to stay in the corpus of texts", "en", "a", 1),
    (60, "spam " * 200, "en", "a", 1000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def rows_of(frame):
    return sorted(map(tuple, frame.select(corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages_on_hard_rows(spark, docs, tmp_path):
    first = corpus_pipeline.quality(spark, docs, "")
    kept = {r.doc_id: r.rules for r in rules.quality_rules(docs).collect()}
    assert rows_of(first) == sorted((r for r in ROWS if kept[r[0]].kept), key=repr)
    assert {1, 2, 3, 60}.isdisjoint(r[0] for r in rows_of(first)) and 10 in {r[0] for r in rows_of(first)}

    second = corpus_pipeline.near_duplicates(spark, first, "")
    texts = {r[0]: r[1] for r in rows_of(first) if r[0] is not None}
    components = plain_components(texts, 80)
    wanted = {i for i, (_, c) in components.items() if i == c} | {r[0] for r in rows_of(first) if r[0] is None}
    assert Counter(r[0] for r in rows_of(second)) == Counter(wanted)  # one row each, repeated rows too

    third = corpus_pipeline.personal_data(spark, second, "")
    before = {r[0]: r for r in rows_of(second)}
    for r in rows_of(third):
        assert (r[2], r[3]) == before[r[0]][2:4] and r[4] == len(r[1])
        assert "@" not in r[1] and "10.1.2.3" not in r[1]

    fourth = corpus_pipeline.mixture(spark, third, "")
    sizes = Counter()
    for r in rows_of(third):
        sizes[r[3]] += len(r[1].split())
    taken = Counter()
    for r in rows_of(fourth):
        taken[r[3]] += len(r[1].split())
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= max(len(r[1].split()) for r in rows_of(third) if r[3] == source)

    last = corpus_pipeline.tokens(spark, fourth, "").collect()
    encoding = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = {r[1]: i for r, i in zip(rows_of(fourth), encoding.texts([r[1] for r in rows_of(fourth)]))}
    assert sorted(r.ids_sha256 for r in last) == sorted(hashlib.sha256(ids[r[1]].encode()).hexdigest() for r in rows_of(fourth))


def test_verdicts_are_computed_once_a_row(docs):
    """The filter on the verdicts holds one copy of the measures: the words of a text and its common words are each taken once."""
    plan = corpus_pipeline.quality(docs.sparkSession, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_run_chains_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    by_hand = docs
    for _, stage in corpus_pipeline.STAGES:
        by_hand = stage(spark, by_hand, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, by_hand.select(got.columns).collect()), key=repr)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "byte-level BPE"]


def test_empty_table(spark, docs, tmp_path):
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_modules():
    assert corpus_pipeline.ORACLE_SQL is None and mixing.SHARE == 1.5 and pii.SUPPORT == 3
