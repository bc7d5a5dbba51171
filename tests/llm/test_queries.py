"""The registered queries and the pipeline over the small tables."""

from __future__ import annotations

import ast
import hashlib
import os
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from compare import compare, connect
from llm.conftest import odd_rows
from llm.test_jaccard_join import brute
from llm.test_native import base_spans, poisson_count

from tidemark.llm import blob_ledger, packing, poisson_mix, queries
from tidemark.plans.staging import staged

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(DATA), DATA, queries.QUERIES[name], queries.ORACLE.get(name))
    assert ok, note
    source = "pages" if name.startswith("op1_") else "conversations" if name.startswith("op12_") else "documents"
    whole = spark.read.parquet(f"{DATA}/{source}.parquet")
    if not name.startswith(("op5_", "op9_", "op11_")):
        assert f"rows={(whole.select('conv_id').distinct() if name.startswith('op12_') else whole).count()} " in note + " "


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def plain_mix(rows: list) -> Counter:
    """How often each document is in the mix, from its source's temperature-scaled share of characters."""
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text or "")
    weights = {k: n**poisson_mix.POWER for k, n in chars.items() if n}
    total = sum(weights.values())
    out = Counter()
    for r in rows:
        if chars[r.source]:
            rate = weights[r.source] / total * sum(chars.values()) * poisson_mix.EPOCHS / chars[r.source]
            name = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
            out[r.doc_id] += poisson_count(rate, int(hashlib.md5(f"{poisson_mix.SEED}:{name}".encode()).hexdigest()[:13], 16) / 2**52)
    return +out


def test_pipeline_stages(spark, odd):
    """Each stage on the result of the one before, against plain Python."""
    secret = spark.createDataFrame([(800, "a " * 60 + "token: abcdefgh12 end", "en", "s0", 1)], odd.schema)
    docs, rows, names = odd.union(secret), [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), "stage")
        rows.append(docs.collect())
        names.append(docs.columns)
    assert len(rows) == 5 and all(c == odd.columns for c in names[:-1])
    clean, single, masked, mixed, pieces = rows
    assert Counter(map(tuple, clean)) <= Counter(odd_rows()) + Counter(map(tuple, secret.collect()))
    kept = {(r[0]) for r in brute([tuple(r) for r in clean]) if r[0] is not None and r[0] == r[2]}
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(kept)
    assert Counter(r.doc_id for r in masked) == Counter(r.doc_id for r in single)
    assert all(base_spans(r.text) == "" for r in masked if r.doc_id == 800)
    assert Counter(r.doc_id for r in mixed) == plain_mix(masked)
    tokenizer = packing._tokenizer(None)
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(tokenizer._encoded([r.text or ""])[0]) + 1
    have = Counter()
    for p in pieces:
        have[p.doc_id] += p.length
    assert have == want


def test_pipeline_on_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), "stage")
    assert docs.count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_native_operators_have_no_python_in_tasks():
    for name in ("interleave", "blob_ledger", "gamma_sampling", "poisson_mix", "line_rules"):
        text = (ROOT / "tidemark/llm" / f"{name}.py").read_text()
        for banned in ("mapInArrow", "mapInPandas", "applyIn", "pandas", "udf", ".rdd"):
            assert banned not in text, (name, banned)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("tidemark.llm" in n for n in names), path


def test_ledger_is_in_the_shared_folder(spark):
    assert blob_ledger.BlobLedger(spark).path.startswith(spark.conf.get("spark.checkpoint.dir"))
