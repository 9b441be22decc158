"""The pipeline's stages against what their operators and plain Python say."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from sparkloom.llm import byte_bpe, mixing, secrets  # noqa: E402
from tests.conftest import DATA  # noqa: E402


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, DATA), name)
        seen[name] = docs.collect()
        assert name == "byte_bpe" or docs.columns == columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dups", "secrets", "mixing", "byte_bpe"]
    assert all(rows[r["doc_id"]] == r for n in ("quality", "near_dups") for r in seen[n])

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(r["text"] or "") for r in seen["near_dups"]]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    kept = [shingles(r["text"] or "") for r in seen["quality"]]
    for s in kept:  # nothing went without a like one staying
        assert not s or any(t and len(s & t) > 0 for t in sets)
    automata = secrets.Scanner(secrets.learn(secrets.labelled_credentials()))
    for r in seen["secrets"]:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        assert not [k for _, k, _ in automata.scan(raw, np.array([0, len(raw)]))[0] if k in (1, 2)]
        assert r["n_chars"] == len(r["text"])
    times = {}
    for r in seen["mixing"]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= mixing.MAX_REPEAT
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert len(seen["byte_bpe"]) == len(seen["mixing"])
    for r in seen["byte_bpe"]:
        assert list(r["ids"]) == own.encode_ordinary(text[r["doc_id"]])


def test_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_odd_rows_go_through(spark):
    """Null, empty, very long, tied and repeated rows, and columns whose names the stages use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = pipeline.quality_stage(spark, docs, DATA).orderBy("doc_id").limit(4).collect()
    text = kept[0]["text"]
    long = " ".join(f"{text} {i}" for i in range(2000))
    ids = [10**9 + i for i in range(4)]
    rows = [(ids[0], text), (ids[1], text), (ids[0], text), (None, text), (None, None), (ids[2], ""), (ids[2], long), (ids[3], kept[1]["text"]), (ids[3], kept[1]["text"])]
    odd = spark.createDataFrame([(i, t, "en", None if k % 2 else "web", None) for k, (i, t) in enumerate(rows)], docs.schema)
    for name in ("mix", "score", "number", "component_id", "statistics", "digest"):
        odd = odd.withColumn(name, F.lit(1))
    columns = odd.columns
    near = pipeline.materialise(pipeline.near_dup_stage(spark, odd, DATA), "odd")
    left = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in near.collect())
    assert near.columns == columns
    assert left == sorted([(str(ids[0]), len(text)), ("None", 0), (str(ids[2]), 0), (str(ids[2]), len(long)), (str(ids[3]), len(kept[1]["text"]))])
    for name, stage in pipeline.STAGES[2:]:
        odd = near = pipeline.materialise(stage(spark, near, DATA), name)
        assert name == "byte_bpe" or near.columns == columns
    assert near.where("n_tokens > 10000").count() <= 3 and near.where("doc_id is null").count() <= 3
    scored = pipeline.quality_stage(spark, spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], docs.schema), DATA)
    assert scored.columns == docs.columns and scored.count() <= 2
