"""The corpus pipeline's stages, each against what it is given."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_duplicates import groups
from turnmill.llm import mixing, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that operators use themselves.
OWN = ["_mark", "_seed", "_score", "_found", "_predicted", "_source", "_of", "row", "mark", "predicted", "digest", "first", "a.b", "ids"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("spark-tables"))
    docs.select(*COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in (5, 6, 9))) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def given(docs):
    """The five columns and many more, whose names the operators also use."""
    return docs.select(*COLUMNS, *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in OWN])


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def _carried(df, given):
    rows = df.collect()
    assert df.columns == given.columns
    assert all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in OWN)


def test_toxicity(spark, given, rows, folder):
    clean = pipeline.drop_toxic(spark, given, folder)
    _carried(clean, given)
    model = toxicity.fit(given, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = model.scores(pa.array([r[1] for r in rows], pa.string())) < toxicity.THRESHOLD
    assert _pairs(clean) == Counter((r[0], r[1]) for r, k in zip(rows, kept, strict=True) if k) and 0.8 * len(rows) < kept.sum() <= len(rows)


def test_near_duplicates(spark, given, rows, folder):
    once = pipeline.drop_near_duplicates(spark, given, folder)
    _carried(once, given)
    assert _pairs(once) == groups(rows, 5, 80)


def test_personal_data(spark, given, rows, folder):
    redacted = pipeline.redact_personal_data(spark, given, folder)
    _carried(redacted, given)
    assert redacted.count() == len(rows)
    assert redacted.where("text like '%ann.lee@example.com%' or n_chars <> length(text)").count() == 0


def test_mixing(spark, given, folder):
    mixed = pipeline.mix_sources(spark, given, folder)
    _carried(mixed, given)
    copies = Counter()
    for r in mixing.mixed(given).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies


def test_packing(spark, given, rows, folder):
    found = pipeline.pack_sequences(spark, given, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter()
    for i, text, *_ in rows:
        sizes[i] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    have, fill = Counter(), Counter()
    for r in found:
        have[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    lengths, counts = np.unique([r["length"] for r in found], return_counts=True)
    assert have == sizes and max(fill.values()) <= 2048
    assert len(fill) <= sum(n for _, n in packing.first_fit(lengths, counts, 2048))


def test_run(spark, folder, empty, tmp_path):
    assert pipeline.run(spark, folder).count() > 0
    empty.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(re.fullmatch("[a-z_]+", name) for name, _ in pipeline.STAGES)
