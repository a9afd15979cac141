"""Every operator on null, empty, very long, repeated and clashing rows, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, jaccard_join, language_id, media, mixing, quality_llr, secret_scan, token_shards, toxicity
from tessera.llm.common import materialise, reach_package

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, " \t\r\n\x0b\x0c", "de", "b"),
    (5, LONG, "en", None),
    (6, LONG + " tail", "en", "a"),
    (None, "a null id, password=hunter2hunter2", "fr", "a"),
    (7, "émile 日本 \U0001f600 ﬁn", "fr", "a"),
    (7, "another text under the same id as the row before", "fr", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    reach_package(spark)
    extra = ["blob", "rid", "n", "sig", "src", "key", "size", "h", "words", "x", "range", "row", "k", "spans", "score", "n_chars", "__blob", "__times"]
    return materialise(spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(-1).alias(c) for c in extra)))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


OPS = {
    "secrets": lambda d, l: secret_scan.summary(d, secret_scan.scan(d)),
    "redact": lambda d, l: secret_scan.redact(d, secret_scan.scan(d)),
    "jaccard": lambda d, l: jaccard_join.join(d),
    "media": lambda d, l: media.features(d),
    "toxicity": lambda d, l: toxicity.classify(d, toxicity.fit(d, l)),
    "language": lambda d, l: language_id.predict(d, language_id.fit(d)),
    "quality": lambda d, l: quality_llr.score(d, l.where("quality = 1")),
    "mixing": lambda d, l: mixing.mix(d),
    "bpe": lambda d, l: bpe.encode_digests(d, bpe.default_path()),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each(docs, none, labels, name):
    assert OPS[name](docs, labels).count() == len(ROWS)
    assert OPS[name](none, labels).count() == 0
    assert OPS[name](none, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_equal_rows_get_equal_values(docs, labels, name):
    got = OPS[name](docs, labels).where("doc_id = 1").collect()
    if name == "mixing":
        assert {(r.size, r.source_size, r.target) for r in got} == {(10, 10 + 10 + 60_001 + 4 + 4, got[0].target)}
    else:
        assert len(got) == 2 and got[0] == got[1]


def test_shards(docs, none):
    r = token_shards.records(docs).collect()
    assert sorted(x.slot for x in r) == list(range(len(r)))
    assert token_shards.records(none).count() == 0


def test_jaccard_values(docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join(docs).collect()}
    assert got[1, 6] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[4, 0] == 4
    assert got[5, 977] == 5 and got[6, 978] == 5  # 977 of 978 shingles are shared


def test_pipeline_filters_keep_columns(docs, labels):
    model = toxicity.fit(docs, labels)
    for out in (toxicity.keep_clean(docs, model), jaccard_join.keep_one(docs), secret_scan.redact(docs, secret_scan.scan(docs)), mixing.sample(docs)):
        assert out.columns == docs.columns
        out.collect()
    clean = {r.text for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect()}
    assert "a null id, [REDACTED:assign]" in clean


def test_chat(spark):
    rows = [(1, 0, "system", "System: be kind"), (1, 1, "user", "User: hello?"), (1, 2, "assistant", "Assistant: hi\nthere"), (1, 2, "assistant", "Assistant: hi\nthere"), (2, None, "user", None), (None, 0, None, "x"), (3, 5, "user", "")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.parse(talk).collect()
    assert len(out) == len(rows)
    assert chat_format.parse(talk.limit(0)).count() == 0
    two = [r.rendered for r in out if r.conv_id == 1 and r.turn == 2]
    assert len(two) == 2 and len(set(two)) == 1
